"""Bridges that hold enclosed pieces of a mask in place.

Boundaries are sampled in raster order of idx: at most 1,000 points of an island, 2,000 of the mainland. Nearest points are found
through grids (``nearest``), so that a source meets what is around it. Only candidate rows, never pixels, reach the ordered choice,
one layer of one picture at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacut.functions.scalars import rounded
from stratacut.operators import batches, small
from stratacut.operators import components as comp
from stratacut.operators.nearest import nearest_join, nearest_of_each
from stratacut.operators.neighborhood import pixels_of, runs

LAYER = ["image_id", "layer_id"]
TIERS = (0.9, 0.8, 0.7, 0.6, 0.0)


def sampled(points: DataFrame, by: list[str], order: list[str], most: Column) -> DataFrame:
    """Of each list the items at floor(i * len / most), or all if they are no more than ``most``."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = points.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", n).withColumn("_m", most)
    step = F.col("_n") / F.col("_m")
    near = [F.ceil(F.col("_r") / step) + d for d in (-1, 0, 1)]
    hit = F.lit(False)
    for i in near:
        hit = hit | ((i >= 0) & (i < F.col("_m")) & (F.floor(i * step) == F.col("_r")))
    return ranked.where((F.col("_n") <= F.col("_m")) | hit).drop("_r", "_n", "_m")


def cut_boundary(cut: DataFrame, ink: DataFrame) -> DataFrame:
    """Pixels of cut components (runs with comp_id) that have ink (runs) as a 4-neighbour."""
    around = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    near = pixels_of(ink).withColumn("o", F.explode(around)).select(*LAYER, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    cells = cut.select(*LAYER, "comp_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")
    return cells.join(near, [*LAYER, "x", "y"], "left_semi")


def sector_centres(bridges: int, opposing: bool) -> list[float]:
    if opposing and bridges == 3:
        return [0.0, math.pi, math.pi / 2]
    if opposing and bridges % 2 == 0:
        return [c for k in range(bridges // 2) for c in (k * math.pi / (bridges / 2), k * math.pi / (bridges / 2) + math.pi)]
    return [k * 2 * math.pi / bridges for k in range(bridges)]


def sector(x: Column, y: Column, cx: Column, cy: Column, centres: list[float]) -> Column:
    """The nearest centre, around the circle, of a point's angle (0 means left); the first of equals."""
    angle = F.atan2(y - cy, x - cx) + F.lit(math.pi)
    def away(c: float) -> Column:
        d = F.abs(angle - F.lit(c))
        return F.when(d > math.pi, 2 * math.pi - d).otherwise(d)
    return F.array_min(F.array(*(F.struct(away(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres))))["k"]


def nearest_targets(sources: DataFrame, targets: DataFrame, within: int | None = None) -> DataFrame:
    """For each source the nearest point of the mainland and of every larger island; the one of least idx of equals.

    sources: (image_id, layer_id, island, area, sx, sy, ...), targets: (image_id, layer_id, target, t_area, mainland, tx, ty, t_idx).
    All larger islands count, so that the result grows with the square of a layer's islands; ``within`` leaves out islands (never the
    mainland) that are farther than so many pixels.
    """
    out = [*sources.columns, "target", "mainland", "tx", "ty"]
    shore = nearest_join(sources, targets.where("mainland"), LAYER, ["t_idx"]).select(*out)
    larger = (F.col("target") != F.col("island")) & (F.col("t_area") > F.col("area"))
    return shore.unionByName(nearest_of_each(sources, targets.where("not mainland"), LAYER, "target", ["t_idx"], larger, within).select(*out))


def line_pixels(segments: DataFrame) -> DataFrame:
    """(image_id, sx, sy, tx, ty, seq, x, y): Bresenham's pixels of distinct segments (image_id, sx, sy, tx, ty), both ends included.

    After k steps along the longer side the line has taken floor((2 k shorter + longer - 1) / (2 longer)) steps along the shorter one: the
    closed form of the error term, in which exact halves don't step yet.
    """
    cast = segments.select(F.col("image_id").cast("long"), *(F.col(c).cast("int") for c in ("sx", "sy", "tx", "ty"))).distinct()
    dx, dy = F.abs(F.col("tx") - F.col("sx")).cast("long"), F.abs(F.col("ty") - F.col("sy")).cast("long")
    k, longer = F.col("seq").cast("long"), F.greatest(dx, dy, F.lit(1))
    steps = lambda own: F.when(own == longer, k).otherwise(F.floor((2 * k * own + longer - 1) / (2 * longer))).cast("int")
    sign = lambda a, b: F.when(F.col(a) < F.col(b), 1).otherwise(-1)
    walked = cast.withColumn("seq", F.explode(F.sequence(F.lit(0), F.greatest(dx, dy).cast("int"))))
    return walked.select("image_id", "sx", "sy", "tx", "ty", "seq", (F.col("sx") + sign("sx", "tx") * steps(dx)).alias("x"), (F.col("sy") + sign("sy", "ty") * steps(dy)).alias("y"))


def coverage(segments: DataFrame, upper: DataFrame | None) -> DataFrame:
    """``segments`` with the share of their line's pixels under ``upper`` (image_id, x, y); 0 without one."""
    if upper is None:
        return segments.withColumn("coverage", F.lit(0.0))
    pixels = line_pixels(segments)
    covered = upper.select("image_id", "x", "y").distinct().withColumn("c", F.lit(1))
    share = pixels.join(covered, ["image_id", "x", "y"], "left").groupBy("image_id", "sx", "sy", "tx", "ty").agg((F.count("c") / F.count("*")).alias("coverage"))
    return segments.join(share, ["image_id", "sx", "sy", "tx", "ty"])


def coverage_by_later(segments: DataFrame, masks: DataFrame, place: Column) -> DataFrame:
    """``segments`` of all layers of a stack with the share of their line's pixels under layers of a later ``place`` (a column over layer_id)."""
    ends = ["image_id", "sx", "sy", "tx", "ty"]
    last = masks.groupBy("image_id", "x", "y").agg(F.max(place).alias("last"))
    seen = line_pixels(segments.select(*ends)).join(last, ["image_id", "x", "y"], "left")
    owned = segments.select(*ends, "layer_id", place.alias("place")).distinct().join(seen, ends)
    share = owned.groupBy(*ends, "layer_id").agg((F.count_if(F.col("last") > F.col("place")) / F.count("*")).alias("coverage"))
    return segments.join(share, [*ends, "layer_id"])


def score(cov: Column, length: Column, near: Column, crossings: Column, mainland: Column) -> Column:
    return cov * 10000 - length - near * 500 - crossings * 1000 - length * 0.1 + F.when(mainland, 200).otherwise(0)


def tier(cov: Column) -> Column:
    """0 for a coverage of at least 0.9, 1 for 0.8, ... 4 for any."""
    return F.when(cov >= 0.9, 0).when(cov >= 0.8, 1).when(cov >= 0.7, 2).when(cov >= 0.6, 3).otherwise(4)


def best_candidates(found: DataFrame) -> DataFrame:
    """Of each island's sector the best candidate without penalties: first tier, then score, then source and target order."""
    length = F.sqrt((F.col("tx") - F.col("sx")) ** 2 + (F.col("ty") - F.col("sy")) ** 2)
    marked = found.withColumn("len", length).withColumn("score", score(F.col("coverage"), length, F.lit(0), F.lit(0), F.col("mainland"))).withColumn("tier", tier(F.col("coverage")))
    w = Window.partitionBy(*LAYER, "island", "sector").orderBy("tier", F.desc("score"), "sy", "sx", F.desc("mainland"), "target")
    return marked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


CHOSEN = "image_id long, layer_id int, island long, sector int, sx int, sy int, tx int, ty int, target long, mainland boolean, coverage double, len double, score double, selected boolean"


def _crossed(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether each segment (4 columns) of ``u`` and its one of ``v`` cross inside (margins 0.01)."""
    a, b, w = u[:, 2:] - u[:, :2], v[:, 2:] - v[:, :2], v[:, :2] - u[:, :2]
    det = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    safe = np.where(np.abs(det) < 1e-10, np.nan, det)
    t, q = (w[:, 0] * b[:, 1] - w[:, 1] * b[:, 0]) / safe, (w[:, 0] * a[:, 1] - w[:, 1] * a[:, 0]) / safe
    return (t > 0.01) & (t < 0.99) & (q > 0.01) & (q < 0.99)


def chooser(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Candidates of whole layers, in order, with score and selected: islands in scan order, sector by sector, with penalties against what is placed.

    A sector's choice needs those before it in its layer, so all layers take their first sectors together, then all their second ones, and so on.
    """
    columns = [c.split()[0] for c in CHOSEN.split(", ")]
    tiers = np.array(TIERS[::-1])

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        seg = rows[["sx", "sy", "tx", "ty"]].to_numpy(float)
        cov, main = rows["coverage"].to_numpy(float), rows["mainland"].to_numpy(bool)
        length = np.sqrt((seg[:, 2] - seg[:, 0]) ** 2 + (seg[:, 3] - seg[:, 1]) ** 2)
        points, chosen = np.full(len(rows), np.nan), np.zeros(len(rows), bool)
        begin = batches.starts(rows, [*LAYER, "island", "sector"])
        size = np.diff(np.append(begin, len(rows)))
        # for each sector, the first sector of its layer and of its island
        of = lambda keys: begin.searchsorted(batches.starts(rows, keys))
        first = lambda keys: np.repeat(of(keys), np.diff(np.append(of(keys), len(begin))))
        layer, island, picked = first(LAYER), first([*LAYER, "island"]), np.zeros(len(begin), np.int64)
        turn = np.arange(len(begin)) - layer
        in_turn = np.argsort(turn, kind="stable")
        for now in np.split(in_turn, np.cumsum(np.bincount(turn))[:-1]) if len(begin) else []:
            g, k = small.spread(size[now])
            g = now[g]
            at = begin[g] + k
            near, crossed = np.zeros(len(at)), np.zeros(len(at))
            before = turn[g]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(before) // small.PAIRS, prepend=0))):
                own, j = small.spread(before[part])
                other = layer[g[part]][own] + j
                u, v = seg[at[part]][own], seg[picked[other]]
                crossed[part] = np.bincount(own, _crossed(u, v), len(part))
                close = (other >= island[g[part]][own]) & ((u[:, 0] - v[:, 0]) ** 2 + (u[:, 1] - v[:, 1]) ** 2 < 16 * width * width)
                near[part] = np.bincount(own, close, len(part))
            points[at] = cov[at] * 10000 - length[at] - 500 * near - 1000 * crossed - length[at] * 0.1 + 200 * main[at]
            starts = np.cumsum(size[now]) - size[now]
            level = tiers[tiers.searchsorted(np.maximum.reduceat(cov[at], starts), "right") - 1]
            own = np.repeat(np.arange(len(now)), size[now])
            value = np.where(cov[at] >= level[own], points[at], -np.inf)
            hit = np.flatnonzero(value == np.maximum.reduceat(value, starts)[own])
            picked[now] = at[hit[np.unique(own[hit], return_index=True)[1]]]  # the first of equals
        chosen[picked] = True
        return rows.assign(len=length, score=points, selected=chosen)[columns]

    return several


def choose(found: DataFrame, width: int) -> DataFrame:
    """Candidates with score and selected (see ``chooser``)."""
    order = ["island", "sector", "sy", "sx", F.desc("mainland"), "target"]
    return batches.by_groups(found, LAYER, order, chooser(width), CHOSEN)


def stamped(lines: DataFrame, width: int, layer: list[str] | None = None) -> DataFrame:
    """Pixels of bridges: a square of floor(width / 2) around every line pixel."""
    half = F.sequence(F.lit(-(width // 2)), F.lit(width // 2))
    keys = layer or LAYER
    return lines.withColumn("_dx", F.explode(half)).withColumn("_dy", F.explode(half)).select(*keys, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).distinct()


def erase(mask: DataFrame, bridges: DataFrame, width: int) -> DataFrame:
    """``mask`` without the bridges (image_id, layer_id, sx, sy, tx, ty)."""
    lines = line_pixels(bridges.select("image_id", "sx", "sy", "tx", "ty")).join(bridges.select(*LAYER, "sx", "sy", "tx", "ty").distinct(), ["image_id", "sx", "sy", "tx", "ty"])
    return mask.join(stamped(lines, width), [*LAYER, "x", "y"], "left_anti")


def candidates(mask: DataFrame, images: DataFrame, bridges: int = 3, each: int = 20, least: int = 0, mainland_only: bool = False, opposing: bool = False, within: int | None = None, single: Column | None = None) -> DataFrame:
    """(image_id, layer_id, island, area, sector, sx, sy, target, mainland, tx, ty) for every island of every layer.

    ``single``: which layers (a column over layer_id) have one sector only, whatever ``bridges`` is.
    """
    return _candidates(mask, images, None, bridges, each, least, mainland_only, opposing, within, single)


def covered_candidates(mask: DataFrame, images: DataFrame, upper: DataFrame | None, bridges: int = 3, each: int = 20, least: int = 0, mainland_only: bool = False, opposing: bool = False, within: int | None = None, single: Column | None = None) -> DataFrame:
    """``candidates`` with their ``coverage`` by ``upper``."""
    if upper is None:
        return coverage(candidates(mask, images, bridges, each, least, mainland_only, opposing, within, single), None)
    return _candidates(mask, images, upper, bridges, each, least, mainland_only, opposing, within, single)


def _candidates(mask: DataFrame, images: DataFrame, upper: DataFrame | None, bridges: int, each: int, least: int, mainland_only: bool, opposing: bool, within: int | None, single: Column | None) -> DataFrame:
    centres, hidden = sector_centres(bridges, opposing), upper is not None

    def whole(c: small.Canvases) -> pd.DataFrame:
        found = small.candidates(c, centres, each, least, mainland_only, within)
        if not hidden:
            return small.as_rows(c, found)
        share = small.covered(c, c.picture[found["layer"]], [found[k] for k in ("sx", "sy", "tx", "ty")], small.cover_of(c))
        return small.as_rows(c, found, coverage=share)

    def few(images: DataFrame, mask: DataFrame, cover: DataFrame | None) -> DataFrame:
        marked = mask if single is None else mask.withColumn("one", single)
        return small.by_pictures(small.with_sizes(marked, images, cover), whole, small.FOUND + (", coverage double" if cover is not None else ""))

    def many(images: DataFrame, mask: DataFrame, cover: DataFrame | None) -> DataFrame:
        found = _by_cells(mask, images, centres, each, least, mainland_only, within, single)
        return found if cover is None else coverage(found, cover)

    return small.either(few, many, comp._saved(images), mask.select(*LAYER, "x", "y"), upper)


def _by_cells(mask: DataFrame, images: DataFrame, centres: list[float], each: int, least: int, mainland_only: bool, within: int | None, single: Column | None) -> DataFrame:
    """``candidates`` by strips and grid cells, whatever the size of a picture."""
    ink = runs(mask)
    cut = comp.label(comp.complement(ink, images, mask.select(*LAYER).distinct()), images)
    known = comp.mainland_and_islands(comp.facts(cut, images), least)
    edge = cut_boundary(cut, ink).join(known.select(*LAYER, "comp_id", "area", "role", "cx", "cy"), [*LAYER, "comp_id"]).join(images, "image_id")
    edge = edge.withColumn("idx", F.col("y").cast("long") * F.col("width") + F.col("x")).drop("width", "height")
    points = comp._saved(sampled(edge, [*LAYER, "comp_id"], ["idx"], F.when(F.col("role") == "mainland", 2000).otherwise(1000)))
    around = sector(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), centres)
    sectors = points.where("role = 'island'").withColumn("sector", around if single is None else F.when(single, F.lit(0)).otherwise(around))
    sources = sampled(sectors, [*LAYER, "comp_id", "sector"], ["idx"], F.lit(each)).select(*LAYER, F.col("comp_id").alias("island"), "area", "sector", F.col("x").alias("sx"), F.col("y").alias("sy"))
    targets = points.select(*LAYER, F.col("comp_id").alias("target"), F.col("area").alias("t_area"), (F.col("role") == "mainland").alias("mainland"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("idx").alias("t_idx"))
    sources = comp._saved(sources)
    if mainland_only:
        return nearest_join(sources, targets.where("mainland"), LAYER, ["t_idx"]).select(*sources.columns, "target", "mainland", "tx", "ty")
    return nearest_targets(sources, targets, within)


def smart_bridges(mask: DataFrame, images: DataFrame, upper: DataFrame | None = None, width: int = 2, **options) -> tuple[DataFrame, DataFrame]:
    """The mask with bridges cut out, and all candidates with what was selected."""
    options = {"bridges": 3, "each": 20, "least": 0, "mainland_only": False, "opposing": False, "within": None, "single": None} | options
    opposing, single = options.pop("opposing"), options.pop("single")
    centres, pick = sector_centres(options.pop("bridges"), opposing), chooser(width)

    def few(images: DataFrame, mask: DataFrame, cover: DataFrame | None) -> DataFrame:
        marked = mask if single is None else mask.withColumn("one", single)
        work = lambda c: small.bridged(c, small.candidates(c, centres, **options), None, width, pick, CHOSEN)
        return small.by_pictures(small.with_sizes(marked, images, cover), work, CHOSEN + KEPT)

    def many(images: DataFrame, mask: DataFrame, cover: DataFrame | None) -> DataFrame:
        listed = comp._saved(choose(coverage(_by_cells(mask, images, centres, single=single, **options), cover), width))
        return _both(listed, erase(mask, listed.where("selected"), width))

    return _apart(comp._saved(small.either(few, many, comp._saved(images), mask.select(*LAYER, "x", "y"), upper)))


KEPT = ", kept boolean"


def _both(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates with what was selected, and pixels that are kept, as one table."""
    return listed.withColumn("kept", F.lit(False)).unionByName(done.select(*LAYER, F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(True).alias("kept")), allowMissingColumns=True)


def _apart(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels that are kept, and candidates."""
    return both.where("kept").select(*LAYER, F.col("sx").alias("x"), F.col("sy").alias("y")), both.where("not kept").drop("kept")


def statistics(listed: DataFrame, layers: DataFrame) -> DataFrame:
    """One row for each of ``layers`` (image_id, layer_id): zeros where there are no islands. Hidden: a coverage of at least 0.6."""
    chosen = listed.groupBy(*LAYER).agg(F.count_distinct("island").alias("islands"), F.count_if("selected").alias("made"), F.avg(F.when(F.col("selected"), F.col("coverage"))).alias("cov"), F.avg(F.when(F.col("selected"), F.col("len"))).alias("length"), F.count_if(F.col("selected") & (F.col("coverage") >= 0.6)).alias("hidden"))
    whole = lambda c: rounded(F.coalesce(c, F.lit(0.0))).cast("int")
    return layers.join(chosen, LAYER, "left").select(*LAYER, F.coalesce("islands", F.lit(0)).cast("long").alias("island_count"), F.coalesce("made", F.lit(0)).cast("long").alias("bridges_created"), whole(F.col("cov") * 100).alias("average_coverage"), whole(F.col("length")).alias("average_bridge_length"), whole(F.col("hidden") / F.nullif(F.col("made"), F.lit(0)) * 100).alias("hidden_bridge_percentage"))


def bridge_stack(masks: DataFrame, images: DataFrame, order: list[int], realistic: bool = True, width: int = 2, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """A whole stack: all pictures at once, layers in ``order`` from dark to light.

    Realistic layers are hidden by the darker ones before them, as already bridged, so the choice goes layer by layer; cartoon
    layers by the lighter ones after them, unbridged, so all are chosen at once. Components, boundaries and candidates, the costly
    part, don't depend on other layers and are found for the whole stack in one pass.
    """
    stack, images = comp._saved(masks.where(F.col("layer_id").isin(order)).select(*LAYER, "x", "y")), comp._saved(images)
    if not realistic:
        place = F.array_position(F.array(*map(F.lit, order)), F.col("layer_id")).cast("int")
        found = candidates(stack, images, bridges=3, each=8, least=least, mainland_only=True, opposing=True, single=F.col("layer_id") != order[0])
        listed = comp._saved(choose(coverage_by_later(found, stack, place), width))
        return comp._saved(erase(stack, listed.where("selected"), width)), listed
    centres, pick = sector_centres(3, False), chooser(width)

    def whole(c: small.Canvases) -> pd.DataFrame:
        return small.bridged(c, small.candidates(c, centres, 20, least, False, None), order, width, pick, CHOSEN)

    def by_layers(images: DataFrame, stack: DataFrame) -> DataFrame:
        found = comp._saved(_by_cells(stack, images, centres, 20, least, False, None, None))
        done, listed = None, None
        for layer in order:
            own = F.col("layer_id") == layer
            rows = comp._saved(choose(coverage(found.where(own), done), width))
            new = comp._saved(erase(stack.where(own), rows.where("selected"), width))
            done, listed = new if done is None else done.unionByName(new), rows if listed is None else listed.unionByName(rows)
        return _both(listed, done)

    return _apart(comp._saved(small.either(lambda images, stack: small.by_pictures(small.with_sizes(stack, images), whole, CHOSEN + KEPT), by_layers, images, stack)))


def simple_anchors(edge: DataFrame, total: Column) -> DataFrame:
    """Anchors of holes: (image_id, layer_id, island, area, anchor, sx, sy) from boundary (.., comp_id, area, role, idx, x, y)."""
    w = Window.partitionBy(*LAYER, "comp_id").orderBy("idx")
    ranked = edge.where("role = 'island'").withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*LAYER, "comp_id"))).withColumn("share", F.col("area") / total)
    many = ranked.withColumn("k", F.when(F.col("share") > 0.03, F.greatest(F.lit(2), F.ceil(F.col("share") * 50))).otherwise(1).cast("int"))
    b = many.withColumn("anchor", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    place = F.when(F.col("k") == 1, F.floor(F.col("n") / 2)).otherwise(F.floor(F.col("anchor") / F.col("k") * F.col("n")))
    return b.where(F.col("r") == place).select(*LAYER, F.col("comp_id").alias("island"), "area", "anchor", F.col("x").alias("sx"), F.col("y").alias("sy"))


def shore_anchors(edge: DataFrame) -> DataFrame:
    """Anchors of the mainland: max(5, floor(n / 200)) points at floor((a + 0.5) / count * n)."""
    w = Window.partitionBy(*LAYER).orderBy("idx")
    ranked = edge.where("role = 'mainland'").withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*LAYER)))
    many = ranked.withColumn("k", F.greatest(F.lit(5), F.floor(F.col("n") / 200)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return many.where(F.col("r") == F.floor((F.col("a") + 0.5) / F.col("k") * F.col("n"))).select(*LAYER, F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("a").alias("t_order")).distinct()


def simple_bridges(mask: DataFrame, images: DataFrame, least: int = 0) -> DataFrame:
    """(image_id, layer_id, island, anchor, sx, sy, tx, ty, target): holes under 1,500 pixels go to the nearest other hole, others to the
    nearest anchor of the mainland (target null), and a cluster of holes without the mainland gets one more bridge (anchor -1).

    All boundaries are those of the mask before anything is cut.
    """
    ink = runs(mask)
    cut = comp.label(comp.complement(ink, images, mask.select(*LAYER).distinct()), images)
    known = comp.mainland_and_islands(comp.facts(cut, images))
    edge = cut_boundary(cut, ink).join(known.select(*LAYER, "comp_id", "area", "role"), [*LAYER, "comp_id"]).join(images, "image_id")
    edge = comp._saved(edge.withColumn("idx", F.col("y").cast("long") * F.col("width") + F.col("x")).withColumn("total", F.col("width").cast("long") * F.col("height")).drop("width", "height"))
    anchors = simple_anchors(edge.where(f"role = 'mainland' or area >= {least}"), F.col("total"))
    shore = shore_anchors(edge)
    keys = [*LAYER, "island", "anchor", "sx", "sy"]
    holes = edge.where("role = 'island'").select(*LAYER, F.col("comp_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), "idx")
    small = nearest_join(anchors.where("area < 1500").select(*keys), holes, LAYER, ["target", "idx"], F.col("target") != F.col("island")).select(*keys, "tx", "ty", "target")

    def ashore(some: DataFrame) -> DataFrame:
        return nearest_join(some, shore, LAYER, ["t_order"]).select(*keys, "tx", "ty", F.lit(None).cast("long").alias("target"))

    plan = comp._saved(small.unionByName(ashore(anchors.join(small, keys, "left_anti").select(*keys))))
    links = plan.select(*LAYER, F.col("island").alias("a"), F.coalesce("target", F.lit(-1)).alias("b"))
    groups = comp._contract(links)
    lost = groups.where("least <> -1 and node <> -1")
    first = lost.groupBy(*LAYER, "least").agg(F.min("node").alias("island"))
    w = Window.partitionBy(*LAYER, "comp_id").orderBy("idx")
    middle = edge.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*LAYER, "comp_id"))).where("r = floor(n / 2)")
    extra = first.join(middle.select(*LAYER, F.col("comp_id").alias("island"), F.col("x").alias("sx"), F.col("y").alias("sy")), [*LAYER, "island"]).select(*LAYER, "island", F.lit(-1).alias("anchor"), "sx", "sy")
    return plan.unionByName(ashore(extra))
