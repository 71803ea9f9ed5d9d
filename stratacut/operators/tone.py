"""Tone bands: thresholds, layer masks, band colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.functions.scalars import luma, opaque, rounded

# Limits of the presets for 2 to 12 layers.
PRESETS = {
    2: (90, 90),
    3: (85, 85, 138),
    4: (60, 60, 100, 150),
    5: (50, 50, 90, 130, 170),
    6: (40, 40, 70, 100, 130, 160),
    7: (30, 30, 60, 90, 120, 150, 180),
    8: (30, 30, 50, 75, 100, 130, 160, 190),
    9: (20, 20, 45, 70, 95, 120, 145, 170, 190),
    10: (15, 15, 45, 70, 95, 120, 145, 165, 180, 195),
    11: (20, 20, 40, 60, 80, 100, 120, 140, 160, 180, 200),
    12: (10, 10, 20, 40, 60, 80, 100, 120, 140, 160, 180, 200),
}


# Colours of the presets for 2 to 12 layers.
PRESET_COLOURS = {
    2: ("#000000", "#FFFFFF"),
    3: ("#000000", "#7F7F7F", "#FFFFFF"),
    4: ("#000000", "#525252", "#A0A0A0", "#FFFFFF"),
    5: ("#000000", "#434343", "#7F7F7F", "#B2B2B2", "#FFFFFF"),
    6: ("#000000", "#3D3D3D", "#676767", "#848484", "#B2B2B2", "#FFFFFF"),
    7: ("#000000", "#313131", "#585858", "#7C7C7C", "#B0B0B0", "#CBCBCB", "#FFFFFF"),
    8: ("#000000", "#2B2B2B", "#484848", "#5F5F5F", "#7C7C7C", "#B0B0B0", "#CBCBCB", "#FFFFFF"),
    9: ("#000000", "#202020", "#505050", "#646464", "#818181", "#A7A7A7", "#C2C2C2", "#D5D5D5", "#FFFFFF"),
    10: ("#000000", "#262626", "#3F3F3F", "#505050", "#6C6C6C", "#8B8B8B", "#ABABAB", "#C4C4C4", "#DFDFDF", "#FFFFFF"),
    11: ("#000000", "#1D1D1D", "#303030", "#4A4A4A", "#5B5B5B", "#808080", "#9E9E9E", "#BABABA", "#D0D0D0", "#E3E3E3", "#FFFFFF"),
    12: ("#000000", "#1B1B1B", "#313131", "#3E3E3E", "#5A5A5A", "#676767", "#7C7C7C", "#9E9E9E", "#BABABA", "#D0D0D0", "#E3E3E3", "#FFFFFF"),
}
OTHER_COLOUR = "#333"


def colours(n: int) -> list[str]:
    """The preset's colours, or one for all layers where there is no preset."""
    return list(PRESET_COLOURS[n]) if n in PRESET_COLOURS else [OTHER_COLOUR] * n


def limits(n: int, given: list[int] | None = None) -> tuple[int, ...]:
    """Given ones if there are ``n``, else the preset, else an even split that ends in 255."""
    if given and len(given) == n:
        return tuple(given)
    return PRESETS.get(n) or tuple(int(255 / n * k + 0.5) for k in range(1, n)) + (255,)


def thresholds(spark: SparkSession, ns: list[int], given: list[int] | None = None) -> DataFrame:
    """(n_layers, layer_id, upper); a few rows, fit for broadcasting."""
    rows = [(n, k, v) for n in ns for k, v in enumerate(limits(n, given))]
    return spark.createDataFrame(rows, "n_layers int, layer_id int, upper int")


def presets(spark: SparkSession, ns: list[int]) -> DataFrame:
    """(n_layers, layer_id, upper, color); a few rows, fit for broadcasting."""
    rows = [(n, k, v, c) for n in ns for k, (v, c) in enumerate(zip(limits(n), colours(n), strict=True))]
    return spark.createDataFrame(rows, "n_layers int, layer_id int, upper int, color string")


def lit_pixels(pixels: DataFrame) -> DataFrame:
    """Opaque pixels with luma: their own, or the column of that name (after a blur)."""
    return pixels.where(opaque()) if "luma" in pixels.columns else pixels.where(opaque()).withColumn("luma", luma())


def layer_masks(pixels: DataFrame, upper: DataFrame) -> DataFrame:
    """(image_id, layer_id, x, y): layer 0 below its limit, layer k at or over its own; opaque pixels only.

    A range join against the few limits, broadcast, so pixels aren't shuffled.
    """
    lit = lit_pixels(pixels).select("image_id", "x", "y", "luma")
    inside = F.when(F.col("layer_id") == 0, F.col("luma") < F.col("upper")).otherwise(F.col("luma") >= F.col("upper"))
    return lit.join(F.broadcast(upper.select("layer_id", "upper")), inside).select("image_id", "layer_id", "x", "y")


def bands(upper: DataFrame) -> DataFrame:
    """``upper`` with the band's lower limit: 0, or the limit before."""
    before = upper.select((F.col("layer_id") + 1).alias("layer_id"), "n_layers", F.col("upper").alias("lower"))
    return upper.join(before, ["n_layers", "layer_id"], "left").withColumn("lower", F.coalesce("lower", F.lit(0)))


def band_of(pixels: DataFrame, upper: DataFrame) -> DataFrame:
    """Opaque pixels with the band lower <= luma < upper that they are in; none over the last limit."""
    lit = lit_pixels(pixels)
    return lit.join(F.broadcast(bands(upper).select("layer_id", "lower", "upper")), (F.col("lower") <= F.col("luma")) & (F.col("luma") < F.col("upper")))


def band_colours(pixels: DataFrame, upper: DataFrame) -> DataFrame:
    """(image_id, layer_id, r, g, b): mean colour of every band of every picture, black where it is empty.

    The join that makes every band of every picture has no condition on purpose: a stack has at most a few layers.
    """
    mean = lambda c: rounded(F.sum(c) / F.count("*")).cast("int").alias(c)
    found = band_of(pixels, upper).groupBy("image_id", "layer_id").agg(mean("r"), mean("g"), mean("b"))
    every = pixels.select("image_id").distinct().join(F.broadcast(upper.select("layer_id")))
    black = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(found, ["image_id", "layer_id"], "left").select("image_id", "layer_id", black("r"), black("g"), black("b"))


def layer_texts(upper: DataFrame) -> DataFrame:
    """Names and descriptions of the layers from their bands, in per cent."""
    per_cent = lambda c: rounded(F.col(c) / 255 * 100).cast("int").cast("string")
    number = (F.col("layer_id") + 1).cast("string")
    name = F.when(F.col("layer_id") == 0, "Layer 1 (Black)").when(F.col("layer_id") == F.col("n_layers") - 1, F.concat(F.lit("Layer "), number, F.lit(" (White)"))).otherwise(F.concat(F.lit("Layer "), number))
    text: Column = F.when(F.col("layer_id") == 0, F.concat(F.lit("Darkest (0–"), per_cent("upper"), F.lit("%)"))).otherwise(F.concat(F.lit("Tones "), per_cent("lower"), F.lit("–"), per_cent("upper"), F.lit("%")))
    return bands(upper).select("n_layers", "layer_id", name.alias("name"), text.alias("description"))
