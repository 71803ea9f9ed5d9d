"""Stacking, merging and recolouring layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gradient of default stack colours.
STACK = ("#0f0f0f", "#2a1f3d", "#4a3560", "#6b5080", "#9b7fa8", "#c4aed0", "#ddd0e8", "#f0eaf6")


def stack_colour(layer_id: Column) -> Column:
    """One of eight colours, in turn."""
    return F.element_at(F.array(*map(F.lit, STACK)), (layer_id % len(STACK) + 1).cast("int"))


def composite(masks: DataFrame, layers: DataFrame) -> DataFrame:
    """(image_id, x, y, color): of the visible layers with ink at a pixel, the one painted last.

    ``layers`` (image_id, layer_id, paint_order, color, visible) are few rows for each picture. Pixels keep one number, order and layer
    together, so they are aggregated by hash and not sorted with their colours, which are joined to what is on top. Of equal orders the
    larger layer_id counts.
    """
    shown = layers.where("visible").select("image_id", "layer_id", "paint_order", "color")
    place = F.col("paint_order").cast("long") * (1 << 32) + F.col("layer_id")
    top = masks.join(shown.drop("color"), ["image_id", "layer_id"]).groupBy("image_id", "x", "y").agg(F.max(place).alias("_top"))
    own = top.withColumn("layer_id", F.pmod("_top", F.lit(1 << 32)).cast("int"))
    return own.join(shown.drop("paint_order"), ["image_id", "layer_id"]).select("image_id", "x", "y", "color")


def on_canvas(pixels: DataFrame, drawn: DataFrame) -> DataFrame:
    """(image_id, x, y, color) of every pixel of the canvas ``pixels``: what is ``drawn`` there, null where it is transparent."""
    return pixels.select("image_id", "x", "y").join(drawn, ["image_id", "x", "y"], "left")


def shown_colours(layers: DataFrame, mode: str, custom: list[str] | None = None) -> DataFrame:
    """``layers`` with color: cartoon and colourised layers keep their own; tone layers take ``custom`` colours, or the stack's, in turn."""
    if mode == "cartoon" or mode == "colorized":
        return layers
    chosen = F.element_at(F.array(*map(F.lit, custom)), (F.col("layer_id") % len(custom) + 1).cast("int")) if custom else stack_colour(F.col("layer_id"))
    return layers.withColumn("color", chosen)


def merge_layers(masks: DataFrame, first: int, second: int, into: int) -> DataFrame:
    """Either's ink in layer ``into``; the other layer's mask goes."""
    both = masks.where(F.col("layer_id").isin(first, second)).select("image_id", F.lit(into).alias("layer_id"), "x", "y").distinct()
    return masks.where(~F.col("layer_id").isin(first, second)).select("image_id", "layer_id", "x", "y").unionByName(both)


def duplicate_layer(masks: DataFrame, layer: int, new: int) -> DataFrame:
    return masks.unionByName(masks.where(F.col("layer_id") == layer).withColumn("layer_id", F.lit(new)))


def preview(canvas: DataFrame, layers: DataFrame) -> DataFrame:
    """(image_id, layer_id, x, y, r, g, b, a): a layer's canvas in the colours of its card.

    ``canvas`` has (image_id, layer_id, x, y, r, g, b, a), ``layers`` (image_id, layer_id, mode, colorized, preview_color, palette_color).
    Tone layers keep their own colours if they are colourised, else take their swatch, and nothing is left where they are transparent;
    colour layers are their palette colour all over (black without one), opaque where alpha is over 128. Colours are read two digits at a
    time, a missing part being 0, so that the default swatch, #333, comes out as (51, 3, 0).
    """
    shown = canvas.join(layers.select("image_id", "layer_id", "mode", "colorized", "preview_color", "palette_color"), ["image_id", "layer_id"])
    tone = F.col("mode") == "realistic"
    digits = F.replace(F.when(tone, F.coalesce(F.nullif("preview_color", F.lit("")), F.lit("#333"))).otherwise(F.coalesce("palette_color", F.lit(""))), F.lit("#"), F.lit(""))
    part = lambda k: F.coalesce(F.conv(F.nullif(F.substring(digits, k, 2), F.lit("")), 16, 10).cast("int"), F.lit(0))
    own = lambda c, k: F.when(tone, F.when(F.col("a") > 0, F.when(F.col("colorized"), F.col(c)).otherwise(part(k))).otherwise(0)).otherwise(part(k)).cast("int").alias(c)
    alpha = F.when(tone, F.col("a")).otherwise(F.when(F.col("a") > 128, 255).otherwise(0)).cast("int").alias("a")
    return shown.select("image_id", "layer_id", "x", "y", own("r", 1), own("g", 3), own("b", 5), alpha)
