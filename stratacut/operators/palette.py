"""Colour palettes: samples, estimates, seeding, assignment, updates, order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacut.functions.scalars import near_white, opaque, rounded
from stratacut.operators import batches
from stratacut.operators.components import _saved, background
from stratacut.operators.neighborhood import images_of

CENTRE = "struct<r:double,g:double,b:double>"


def stride_sample(pixels: DataFrame, limit: int) -> DataFrame:
    """Every max(1, floor(n / limit))-th pixel in raster order, transparent ones too, with idx."""
    step = F.greatest(F.lit(1), F.floor(F.col("width") * F.col("height") / limit))
    sized = pixels.join(images_of(pixels), "image_id").withColumn("idx", F.col("y").cast("long") * F.col("width") + F.col("x"))
    return sized.where(F.col("idx") % step == 0).drop("width", "height")


def distance(r: Column, g: Column, b: Column, c: Column) -> Column:
    return (r - c["r"]) * (r - c["r"]) + (g - c["g"]) * (g - c["g"]) + (b - c["b"]) * (b - c["b"])


def estimate_count(pixels: DataFrame, tolerance: int = 15, apart: int = 7500) -> DataFrame:
    """(image_id, n_colors): leaders in raster order, each at least ``apart`` (squared) from all before; 2 to 20.

    A picture's list has at most twice the sample limit of 5,000 pixels.
    """
    seen = stride_sample(pixels, 5000).where(opaque() & ~near_white(tolerance, strict=True))
    listed = seen.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("l"))
    leaders = F.aggregate("l", F.expr("cast(array() as array<struct<r:int,g:int,b:int>>)"), lambda acc, p: F.when((F.size(acc) >= 20) | F.exists(acc, lambda c: distance(p["r"], p["g"], p["b"], c) < apart), acc).otherwise(F.array_append(acc, F.struct(p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b")))))
    found = listed.select("image_id", F.size(leaders).alias("n"))
    return pixels.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.greatest(F.lit(2), F.least(F.lit(20), F.coalesce("n", F.lit(0)))).alias("n_colors"))


def nearest(r: Column, g: Column, b: Column, palette: Column) -> Column:
    """Index of the nearest entry of an array of colours; the first of equals."""
    return F.array_min(F.transform(palette, lambda c, i: F.struct(distance(r, g, b, c).alias("d"), i.alias("k"))))["k"]


def as_array(palette: DataFrame) -> DataFrame:
    """(image_id, palette): entries (image_id, k, r, g, b) by k, as one array for each picture."""
    listed = palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("k", "r", "g", "b"))).alias("p"))
    return listed.select("image_id", F.transform("p", lambda c: F.struct(c["r"].cast("double").alias("r"), c["g"].cast("double").alias("g"), c["b"].cast("double").alias("b"))).alias("palette"))


def assign(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """``pixels`` with k of their picture's nearest palette entry."""
    joined = pixels.join(as_array(palette), "image_id")
    return joined.withColumn("k", nearest(F.col("r"), F.col("g"), F.col("b"), F.col("palette"))).drop("palette")


def update(assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """Entries moved to the mean of their pixels; an entry without any keeps its place."""
    means = assigned.groupBy("image_id", "k").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"))
    return palette.join(means, ["image_id", "k"], "left").select("image_id", "k", *(F.coalesce(f"m{c}", F.col(c).cast("double")).alias(c) for c in "rgb"))


def farthest_seeds(samples: DataFrame, n: int) -> DataFrame:
    """(image_id, k, r, g, b): the first sample, then always the one farthest from all before (lowest idx of equals)."""
    samples = _saved(samples.select("image_id", "idx", "r", "g", "b"))
    pick = lambda df: df.select("image_id", F.col("s.r").alias("r"), F.col("s.g").alias("g"), F.col("s.b").alias("b"))
    seeds = _saved(pick(samples.groupBy("image_id").agg(F.min(F.struct("idx", "r", "g", "b")).alias("s"))).withColumn("k", F.lit(0)))
    for k in range(1, n):
        chosen = as_array(seeds)
        away = samples.join(chosen, "image_id").withColumn("d", F.array_min(F.transform("palette", lambda c: distance(F.col("r"), F.col("g"), F.col("b"), c))))
        nxt = away.groupBy("image_id").agg(F.max(F.struct("d", (-F.col("idx")).alias("back"), "r", "g", "b")).alias("s"))
        seeds = _saved(seeds.unionByName(pick(nxt.where("s.d > 0")).withColumn("k", F.lit(k))))
    return seeds.select("image_id", "k", "r", "g", "b")


def drawn(*parts: Column | str | int) -> Column:
    """A number from 0 to under 1 that depends on ``parts`` alone: 52 bits of their md5."""
    text = F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def weighted_seeds(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(image_id, k, r, g, b): k-means++; a random first sample, then samples drawn in proportion to their squared distance from all before.

    The draw is the least -ln(u) / d2, u being a hash of (seed, image_id, idx, k): the same for any split of the samples.
    """
    samples = _saved(samples.select("image_id", "idx", "r", "g", "b"))
    seeds = None
    for k in range(n):
        u = drawn(seed, "image_id", "idx", k)
        if seeds is None:
            left = samples.withColumn("key", u)
        else:
            d2 = F.array_min(F.transform("palette", lambda c: distance(F.col("r"), F.col("g"), F.col("b"), c)))
            left = samples.join(as_array(seeds), "image_id").withColumn("d2", d2).where("d2 > 0").withColumn("key", -F.ln(F.greatest(u, F.lit(1e-300))) / F.col("d2"))
        first = left.groupBy("image_id").agg(F.min(F.struct("key", "idx", "r", "g", "b")).alias("s"))
        chosen = first.select("image_id", F.lit(k).alias("k"), *(F.col(f"s.{c}").alias(c) for c in "rgb"))
        seeds = _saved(chosen if seeds is None else seeds.unionByName(chosen))
    return seeds


def _from(r: Column, g: Column, b: Column, centres: np.ndarray) -> Column:
    """struct<d, k>: the nearest of a few centres, the first of equals."""
    entries = [F.struct(distance(r, g, b, {c: F.lit(v) for c, v in zip("rgb", row, strict=True)}).alias("d"), F.lit(k).alias("k")) for k, row in enumerate(centres.tolist())]
    return F.array_min(F.array(*entries))


def corpus_palette(pixels: DataFrame, n: int, draws: int = 5, oversample: int | None = None, rounds: int = 12, seed: int = 0) -> DataFrame:
    """(k, r, g, b): one palette of at most ``n`` colours for all pictures together.

    Pictures are first counted by colour, so that all further work is on at most 2^24 weighted colours, whatever the corpus. Seeding is
    k-means||: a random first colour; then ``draws`` times every colour joins by itself with a probability in proportion to its pixels
    times its squared distance, some ``oversample`` (twice n) a time; what has joined is weighted by the pixels nearest to it, and the n that
    are heaviest and farthest from each other seed Lloyd's rounds, which are sums of all tasks. On the driver are only the colours
    that joined, some draws x oversample of them, and the palette.
    """
    many = oversample or 2 * n
    colours = _saved(pixels.where(opaque()).groupBy("r", "g", "b").agg(F.count("*").alias("w")))
    rgb = [F.col(c) for c in "rgb"]
    first = colours.orderBy(drawn(seed, *"rgb") / F.col("w"), *"rgb").first()
    if first is None:
        return colours.select(F.lit(0).alias("k"), *"rgb").limit(0)
    joined = np.array([[first.r, first.g, first.b]])
    for j in range(1, draws + 1):
        away = colours.withColumn("d", _from(*rgb, joined)["d"].cast("long") * F.col("w"))
        total = away.agg(F.sum("d")).first()[0]
        if not total:
            break
        more = away.where(drawn(seed, *"rgb", j) * F.lit(float(total)) < F.col("d").cast("double") * F.lit(float(many))).select(*"rgb").collect()
        joined = np.concatenate([joined, np.array([list(r) for r in more]).reshape(-1, 3)]).astype(int)
    joined = np.array(sorted(set(map(tuple, joined.tolist()))))
    near = colours.groupBy(_from(*rgb, joined)["k"].alias("k")).agg(F.sum("w").alias("w")).collect()
    weight = np.zeros(len(joined), np.int64)
    for r in near:
        weight[r.k] = r.w
    chosen = [int(weight.argmax())]
    apart = ((joined - joined[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and (apart * weight).max() > 0:
        chosen.append(int((apart * weight).argmax()))
        apart = np.minimum(apart, ((joined - joined[chosen[-1]]) ** 2).sum(1))
    centres = joined[chosen].astype(float)
    for _ in range(rounds):
        sums = colours.groupBy(_from(*rgb, centres)["k"].alias("k")).agg(F.sum("w").alias("w"), *(F.sum(F.col(c).cast("long") * F.col("w")).alias(c) for c in "rgb")).collect()
        new = centres.copy()
        for row in sums:
            new[row.k] = [row.r / row.w, row.g / row.w, row.b / row.w]
        if (new == centres).all():
            break
        centres = new
    rows = [(k, *(int(v) for v in np.floor(c + 0.5))) for k, c in enumerate(centres)]
    return pixels.sparkSession.createDataFrame(rows, "k int, r int, g int, b int")


PALETTE = "image_id long, k int, r int, g int, b int"


def _lloyd(c: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Farthest-point seeds of colours (in raster order) and Lloyd's rounds from them; sums of whole numbers are exact in any order."""
    centres = [c[0]]
    near = ((c - c[0]) ** 2).sum(1)
    while len(centres) < n and near.max() > 0:
        centres.append(c[int(near.argmax())])
        near = np.minimum(near, ((c - centres[-1]) ** 2).sum(1))
    p = np.array(centres, float)
    for _ in range(rounds):
        k = np.zeros(len(c), np.int64)
        best = ((c - p[0]) ** 2).sum(1)
        for j in range(1, len(p)):
            d = ((c - p[j]) ** 2).sum(1)
            k = np.where(d < best, j, k)
            best = np.minimum(best, d)
        count = np.bincount(k, minlength=len(p))
        new = np.stack([np.bincount(k, c[:, i], len(p)) for i in range(3)], 1) / np.maximum(count, 1)[:, None]
        new[count == 0] = p[count == 0]
        if (new == p).all():
            break
        p = new
    return np.floor(p + 0.5).astype(np.int32)


def quantize(pixels: DataFrame, n: int, rounds: int = 12, counts: DataFrame | None = None) -> DataFrame:
    """(image_id, k, r, g, b): palettes of at most ``n`` colours by Lloyd's rounds over the stride sample, rounded at the end.

    A picture's sample has fewer than 160,000 pixels whatever its size, so all rounds of a picture run in one task, and no table
    is written between them; pictures are what is dealt out. ``counts`` (image_id, n_colors) sets a picture's own number.
    """
    samples = stride_sample(pixels, 80_000).where(opaque()).select("image_id", "idx", "r", "g", "b")
    own = samples.withColumn("n", F.lit(n)) if counts is None else samples.join(counts.select("image_id", F.least("n_colors", F.lit(n)).alias("n")), "image_id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        first = batches.starts(rows, ["image_id"])
        c, many, ids = rows[["r", "g", "b"]].to_numpy(float), rows["n"].to_numpy(), rows["image_id"].to_numpy()
        made = [_lloyd(c[a:b], int(many[a]), rounds) for a, b in zip(first, [*first[1:], len(c)], strict=True)]
        p, sizes = np.concatenate(made), [len(m) for m in made]
        k = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pd.DataFrame({"image_id": np.repeat(ids[first], sizes), "k": k, "r": p[:, 0], "g": p[:, 1], "b": p[:, 2]})

    return batches.by_groups(own, ["image_id"], ["idx"], fit, PALETTE)


def colour_layers(pixels: DataFrame, palette: DataFrame, tolerance: int = 15) -> DataFrame:
    """(image_id, layer_id, x, y): opaque pixels off the background, by their nearest palette entry."""
    ink = pixels.where(opaque())
    if tolerance > 0:
        ink = ink.join(background(pixels, tolerance), ["image_id", "x", "y"], "left_anti")
    return assign(ink, palette).select("image_id", F.col("k").cast("int").alias("layer_id"), "x", "y")


def paint_order(palette: DataFrame) -> DataFrame:
    """``palette`` with luminance and its place from dark to light; the first k of equals first."""
    lum = (F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b")) / 255
    w = Window.partitionBy("image_id").orderBy("luminance", "k")
    return palette.withColumn("luminance", lum).withColumn("paint_order", F.row_number().over(w) - 1)
