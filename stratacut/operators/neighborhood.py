"""Windows over rows and columns of pixels: blur, dilation, boundaries, runs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacut.functions.scalars import rounded
from stratacut.operators import small
from stratacut.operators.components import _saved


def kernel(radius: float) -> list[float]:
    """Weights of 2*ceil(r)+1 taps, sigma r/2, in single precision before and after they are made to sum up to 1."""
    reach, sigma = math.ceil(radius), radius / 2
    raw = [float(np.float32(math.exp(-(k * k) / (2 * sigma * sigma)))) for k in range(-reach, reach + 1)]
    total = 0.0
    for w in raw:
        total += w
    return [float(np.float32(w / total)) for w in raw]


def _pass(value: str, along: str, across: str, weights: list[float]) -> Column:
    w = Window.partitionBy("image_id", across).orderBy(along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = len(weights) // 2
    out = F.lit(0.0)
    for k, weight in enumerate(weights):
        d = k - reach
        v = F.col(value) if d == 0 else F.coalesce(F.lag(value, -d).over(w), F.first(value).over(whole)) if d < 0 else F.coalesce(F.lead(value, d).over(w), F.last(value).over(whole))
        out = out + v.cast("double") * F.lit(weight)
    return out


def blur(pixels: DataFrame, radius: float, value: str = "luma", images: DataFrame | None = None) -> DataFrame:
    """``value`` after a separable Gaussian with clamped edges; a radius under 1 leaves it. ``images``: sizes, a saved table if given."""
    if radius < 1:
        return pixels
    weights = kernel(radius)

    def by_windows(_, some: DataFrame) -> DataFrame:
        across = some.withColumn("_h", _pass(value, "x", "y", weights).cast("float"))
        return across.withColumn(value, rounded(_pass("_h", "y", "x", weights)).cast("int")).drop("_h")

    images = _saved(images_of(pixels)) if images is None else images
    return small.either(lambda _, some: small.blurred(some, weights, value), by_windows, images, pixels)


def runs(mask: DataFrame) -> DataFrame:
    """(image_id, layer_id, y, x0, x1): maximal horizontal runs of a mask's pixels."""
    w = Window.partitionBy("image_id", "layer_id", "y").orderBy("x")
    island = mask.withColumn("_g", F.col("x") - F.row_number().over(w))
    return island.groupBy("image_id", "layer_id", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def pixels_of(spans: DataFrame) -> DataFrame:
    return spans.select("image_id", "layer_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def merged(spans: DataFrame) -> DataFrame:
    """Runs with overlapping or touching ones of a row made one."""
    w = Window.partitionBy("image_id", "layer_id", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("x0") > reach + 1, 1).otherwise(F.when(reach.isNull(), 1).otherwise(0)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("image_id", "layer_id", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def dilate(spans: DataFrame, images: DataFrame, radius: int) -> DataFrame:
    """Runs grown by a disc of ``radius`` and clipped to the canvas: 2r+1 rows for each run, not a disc for each pixel."""
    if radius < 1:
        return spans
    rows = F.array(*(F.struct(F.lit(d).alias("dy"), F.lit(math.isqrt(radius * radius - d * d)).alias("dx")) for d in range(-radius, radius + 1)))
    grown = spans.select("image_id", "layer_id", "y", "x0", "x1", F.explode(rows).alias("o")).join(images, "image_id")
    grown = grown.select("image_id", "layer_id", (F.col("y") + F.col("o.dy")).alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("o.dx")).alias("x0"), F.least(F.col("width") - 1, F.col("x1") + F.col("o.dx")).alias("x1"), "height")
    return merged(grown.where("y >= 0 and y < height").drop("height"))


def images_of(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) of dense pixel tables."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def boundary(dense: DataFrame) -> DataFrame:
    """Pixels of (image_id, layer_id, x, y, ink) with a 4-neighbour of the other kind inside the canvas."""
    row, column = Window.partitionBy("image_id", "layer_id", "y").orderBy("x"), Window.partitionBy("image_id", "layer_id", "x").orderBy("y")
    other = lambda c: F.coalesce(c != F.col("ink"), F.lit(False))
    return dense.withColumn("_b", other(F.lag("ink").over(row)) | other(F.lead("ink").over(row)) | other(F.lag("ink").over(column)) | other(F.lead("ink").over(column))).where("_b").drop("_b")
