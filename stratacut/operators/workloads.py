"""The three workloads from end to end: tone layers, colour layers, and bridges of vector documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacut.functions.scalars import luma, to_hex
from stratacut.operators import bridges as bridging
from stratacut.operators import components, neighborhood, palette, tone, vector
from stratacut.operators.components import _saved


class Stack(NamedTuple):
    """masks (image_id, layer_id, x, y) as they are cut; clean, the same before bridging; layers, one row for each layer of each
    picture; listed, all bridge candidates with what was selected (None without bridging)."""

    masks: DataFrame
    clean: DataFrame
    layers: DataFrame
    listed: DataFrame | None


def tone_stack(pixels: DataFrame, n: int, given: list[int] | None = None, blur: int = 0, cleanup: int = 0, bridge: bool = False, width: int = 2, least: int = 0) -> Stack:
    """Pictures to tone layers: blur, bands, clean-up, a copy kept before bridges, bridges from dark to light, names, limits and colours."""
    upper = tone.thresholds(pixels.sparkSession, [n], given)
    images = _saved(neighborhood.images_of(pixels))
    soft = _saved(neighborhood.blur(pixels.withColumn("luma", luma()), blur, images=images))
    masks = tone.layer_masks(soft, upper)
    if cleanup > 0:
        masks = neighborhood.pixels_of(components.clean(masks, images, cleanup))
    clean = _saved(masks)
    means = tone.band_colours(soft, upper).select("image_id", "layer_id", to_hex(F.col("r"), F.col("g"), F.col("b")).alias("color"))
    facts = tone.layer_texts(upper).join(tone.bands(upper), ["n_layers", "layer_id"])
    layers = means.join(F.broadcast(facts), "layer_id").select(
        "image_id", "layer_id", F.col("layer_id").alias("paint_order"), "name", "description", F.lit("realistic").alias("mode"), "lower", "upper", "color", F.lit(True).alias("visible"),
    )
    if not bridge:
        return Stack(clean, clean, layers, None)
    done, listed = bridging.bridge_stack(clean, images, list(range(n)), True, width, least)
    return Stack(done, clean, layers, listed)


def colour_stack(pixels: DataFrame, n: int | None = None, tolerance: int = 15, bleed: int = 1, bridge: bool = False, width: int = 2, least: int = 200, rounds: int = 12) -> Stack:
    """Pictures to colour layers: palette (of ``n`` colours, or of as many as each picture is estimated to have), background off,
    nearest colours, paint order from dark to light, bleed of all but the darkest, bridges, names and colours.

    layer_id is the place in the paint order.
    """
    images = _saved(neighborhood.images_of(pixels))
    if n is None:
        counts = palette.estimate_count(pixels)
        made = palette.quantize(pixels, 20, rounds, counts)
    else:
        made = palette.quantize(pixels, n, rounds)
    ordered = _saved(palette.paint_order(made))
    flat = palette.colour_layers(pixels, made, tolerance).withColumnRenamed("layer_id", "k")
    masks = _saved(flat.join(ordered.select("image_id", "k", F.col("paint_order").cast("int").alias("layer_id")), ["image_id", "k"]).select("image_id", "layer_id", "x", "y"))
    if bleed > 0:
        lighter = neighborhood.dilate(neighborhood.runs(masks.where("layer_id > 0")), images, bleed)
        masks = _saved(masks.where("layer_id = 0").unionByName(neighborhood.pixels_of(lighter)))
    shade = to_hex(F.col("r"), F.col("g"), F.col("b"))
    layers = ordered.select(
        "image_id", F.col("paint_order").cast("int").alias("layer_id"), "paint_order", F.concat(F.lit("Color "), (F.col("k") + 1).cast("string")).alias("name"), F.upper(shade).alias("description"),
        F.lit("cartoon").alias("mode"), "luminance", shade.alias("color"), F.lit(True).alias("visible"),
    )
    if not bridge:
        return Stack(masks, masks, layers, None)
    most = layers.agg(F.max("layer_id")).first()[0] or 0  # at most 20 layers
    done, listed = bridging.bridge_stack(masks, images, list(range(most + 1)), False, width, least)
    return Stack(done, masks, layers, listed)


def vector_documents(svgs: DataFrame, width: float = 3, fill: str = "black", tolerance: float = 1.5) -> DataFrame:
    """(doc_id, svg): contours of documents read, simplified, every island joined to the mainland by its shortest clear bridge, and written."""
    vertices = _saved(vector.flatten(vector.paths(svgs)))
    return vector.documents(vector.bridged_paths(vertices, width, tolerance), svgs, fill)

