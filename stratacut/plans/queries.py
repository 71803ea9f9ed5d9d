"""The registered queries over the fixture views, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.functions import scalars as s
from stratacut.operators import bridges, components, compose, export, neighborhood, palette, tone, vector, workloads
from stratacut.plans.sql import ORACLES
from stratacut.sources import fixtures, png, raster_io
from stratacut.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FOUR = 4


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def limits(spark: SparkSession, n: int = FOUR) -> DataFrame:
    return tone.thresholds(spark, [n])


def band_masks(spark: SparkSession, pixels: DataFrame) -> DataFrame:
    return tone.layer_masks(pixels, limits(spark))


def dark_mask(pixels: DataFrame) -> DataFrame:
    """One layer: opaque pixels under luma 100."""
    return pixels.where(s.opaque() & (s.luma() < 100)).select("image_id", F.lit(0).alias("layer_id"), "x", "y")


@query
def s02_decode_data_urls(spark, sf):
    found = fixtures.data_urls(spark, sf).withColumn("d", raster_io.decode_url(F.col("url"))).where(raster_io.is_picture(F.col("d.mime")))
    return found.select("upload_id", F.col("d.mime").alias("mime"), F.length("d.bytes").alias("n_bytes"), F.md5("d.bytes").alias("md5"))


@query
def s05_shrink(spark, sf):
    return raster_io.shrink(fixtures.swatches(spark, sf), 12)


@query
def s07_file_names(spark, sf):
    return band_masks(spark, fixtures.thumbs(spark, sf)).groupBy("layer_id").count().select(export.file_name(F.col("layer_id")).alias("file"), F.col("count").alias("n_pixels"))


@query
def s07_mode_file_names(spark, sf):
    ink = band_masks(spark, fixtures.thumbs(spark, sf)).groupBy("layer_id").count()
    modes = ink.select("layer_id", "count", F.explode(F.array(F.lit("realistic"), F.lit("cartoon"))).alias("mode"))
    return modes.select(export.file_name(F.col("layer_id"), F.col("mode")).alias("file"), F.col("count").alias("n_pixels"))


@query
def s09_enlarged_pixels(spark, sf):
    pixels = fixtures.thumbs(spark, sf).select("image_id", F.lit(0).alias("layer_id"), "x", "y", "r", "g", "b", "a")
    big = raster_io.enlarged(pixels, neighborhood.images_of(pixels), 4)
    return big.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("r") * (F.col("x") + 1)).alias("sr"), F.sum(F.col("g") * (F.col("y") + 1)).alias("sg"), F.sum("b").alias("sb"))


@query
def p01_luma(spark, sf):
    return fixtures.thumbs(spark, sf).select("image_id", "x", "y", s.luma().alias("luma"))


@query
def p02_opaque(spark, sf):
    return fixtures.swatches(spark, sf).where(s.opaque()).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"))


@query
def p03_near_white(spark, sf):
    count = lambda t, strict, name: F.count_if(s.near_white(t, strict)).alias(name)
    return fixtures.thumbs(spark, sf).groupBy("image_id").agg(count(15, True, "strict_15"), count(15, False, "wide_15"), count(60, False, "wide_60"))


@query
def p04_binarise(spark, sf):
    return fixtures.thumbs(spark, sf).groupBy("image_id").agg(*(F.sum(s.inked(c)).alias(f"over_{c}") for c in (0, 10, 128)))


@query
def p05_stride_sample(spark, sf):
    return palette.stride_sample(fixtures.posters(spark, sf), 5000).select("image_id", "idx", "r", "g", "b", "a")


@query
def p06_recolour(spark, sf):
    masks = band_masks(spark, fixtures.thumbs(spark, sf))
    return masks.select("image_id", "layer_id", "x", "y", s.from_hex(compose.stack_colour(F.col("layer_id"))).alias("c")).select("image_id", "layer_id", "x", "y", "c.r", "c.g", "c.b")


@query
def p06_preview_modes(spark, sf):
    """Small pictures with soft alpha as one layer's canvas: own colours, a swatch, the default swatch, a palette colour and none, in turn."""
    pixels = fixtures.thumbs(spark, sf)
    canvas = pixels.select("image_id", F.lit(0).alias("layer_id"), "x", "y", "r", "g", "b", F.when(F.col("a") == 0, 0).otherwise(F.col("b")).alias("a"))
    turn = F.col("image_id") % 5
    layers = pixels.select("image_id").distinct().select(
        "image_id", F.lit(0).alias("layer_id"), F.when(turn < 3, "realistic").otherwise("cartoon").alias("mode"), (turn == 0).alias("colorized"),
        F.when(turn == 1, compose.stack_colour(F.col("image_id"))).alias("preview_color"), F.when(turn == 3, "#A1b2C3").alias("palette_color"))
    return compose.preview(canvas, layers)


@query
def p07_hex(spark, sf):
    pixels = fixtures.thumbs(spark, sf).withColumn("hex", s.to_hex(F.col("r"), F.col("g"), F.col("b")))
    odd = F.when(F.col("x") == 7, F.concat("hex", F.lit("0"))).otherwise(F.col("hex"))
    return pixels.withColumn("c", s.from_hex(odd)).select("image_id", "x", "y", "hex", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"))


@query
def p08_layer_texts(spark, sf):
    """Texts of the layers that pixels of the pictures are in."""
    used = band_masks(spark, fixtures.thumbs(spark, sf)).groupBy("layer_id").count()
    return tone.layer_texts(limits(spark)).join(used, "layer_id").select("layer_id", "name", "description", F.col("count").alias("n_pixels"))


@query
def p09_clamped_thresholds(spark, sf):
    edits = fixtures.edit_events(spark, sf).where("setting = 'threshold'")
    array = F.array(*map(F.lit, tone.limits(FOUR)))
    return edits.select("event_id", F.array_join(s.clamped_thresholds(array, F.col("layer_id"), F.col("value")).cast("array<string>"), ",").alias("limits"))


@query
def p10_marker_scale(spark, sf):
    images = neighborhood.images_of(fixtures.posters(spark, sf)).withColumn("w", F.col("width") * (F.col("image_id") % 7))
    k = s.marker_scale(F.col("w"))
    return images.select("image_id", "w", s.rounded(k * 14).cast("int").alias("arm"), F.greatest(F.lit(1), s.rounded(k * 3)).cast("int").alias("thick"), s.rounded(k * 24).cast("int").alias("margin"))


@query
def t01_thresholds(spark, sf):
    """How many opaque pixels are under each limit of the presets for 2 to 12 layers and an even split of 14."""
    lit = fixtures.thumbs(spark, sf).where(s.opaque()).groupBy(s.luma().alias("luma")).count()
    table = tone.thresholds(spark, [*range(2, 13), 14])
    return lit.join(F.broadcast(table), F.col("luma") < F.col("upper")).groupBy("n_layers", "layer_id", "upper").agg(F.sum("count").alias("n_under"))


@query
def t02_layer_masks(spark, sf):
    return band_masks(spark, fixtures.swatches(spark, sf))


@query
def t03_bands(spark, sf):
    return tone.band_of(fixtures.swatches(spark, sf), limits(spark)).select("image_id", "x", "y", "layer_id", "luma")


@query
def t04_band_colours(spark, sf):
    return tone.band_colours(fixtures.swatches(spark, sf), limits(spark))


def tone_preview(spark: SparkSession, sf: str, pixels: DataFrame) -> DataFrame:
    """Bands, mean colours and stack of every picture: pixels per colour of the preview."""
    upper = limits(spark)
    colours = tone.band_colours(pixels, upper).select("image_id", "layer_id", F.col("layer_id").alias("paint_order"), s.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("color"), F.lit(True).alias("visible"))
    return compose.composite(tone.layer_masks(pixels, upper), colours).groupBy("image_id", "color").agg(F.count("*").alias("n_pixels"))


@query
def w1_tone_preview(spark, sf):
    return tone_preview(spark, sf, fixtures.thumbs(spark, sf))


@query
def t05_tone_layers(spark, sf):
    """Blur, bands and clean-up of every swatch: ink per layer."""
    pixels = fixtures.swatches(spark, sf).withColumn("luma", s.luma())
    images = components._saved(neighborhood.images_of(pixels))
    soft = neighborhood.blur(pixels, 2, images=images)
    upper = limits(spark)
    inside = F.when(F.col("layer_id") == 0, F.col("luma") < F.col("upper")).otherwise(F.col("luma") >= F.col("upper"))
    masks = soft.where(s.opaque()).join(F.broadcast(upper), inside).select("image_id", "layer_id", "x", "y")
    done = components.clean(masks, images, 5)
    return done.groupBy("image_id", "layer_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("ink"))


@query
def k01_colour_count(spark, sf):
    return palette.estimate_count(fixtures.swatches(spark, sf))


@query
def k02_farthest_seeds(spark, sf):
    samples = palette.stride_sample(fixtures.thumbs(spark, sf), 80_000).where(s.opaque())
    return palette.farthest_seeds(samples, 4)


def seeds_of(spark, sf):
    pixels = fixtures.thumbs(spark, sf)
    first = pixels.where(s.opaque() & (F.col("y") == 0)).groupBy("image_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("x", "r", "g", "b"))), 1, 3).alias("l"))
    return pixels, first.select("image_id", F.posexplode("l").alias("k", "c")).select("image_id", "k", "c.r", "c.g", "c.b")


@query
def k03_assign(spark, sf):
    pixels, seeds = seeds_of(spark, sf)
    return palette.assign(pixels.where(s.opaque()), seeds).select("image_id", "x", "y", F.col("k").cast("int").alias("k"))


@query
def k04_update(spark, sf):
    pixels, seeds = seeds_of(spark, sf)
    moved = palette.update(palette.assign(pixels.where(s.opaque()), seeds), seeds)
    return moved.select("image_id", F.col("k").cast("int").alias("k"), *(s.rounded(F.col(c)).cast("int").alias(c) for c in "rgb"))


@query
def k02_weighted_seeds(spark, sf):
    return palette.weighted_seeds(palette.stride_sample(fixtures.thumbs(spark, sf), 80_000).where(s.opaque()), 4)


@query
def k05_corpus_palette(spark, sf):
    """One palette of six colours for all small pictures together."""
    return palette.corpus_palette(fixtures.thumbs(spark, sf), 6, draws=3)


@query
def k05_palette(spark, sf):
    return palette.quantize(fixtures.thumbs(spark, sf), 4)


@query
def k06_colour_layers(spark, sf):
    pixels, seeds = seeds_of(spark, sf)
    return palette.colour_layers(pixels, seeds)


@query
def k07_paint_order(spark, sf):
    _, seeds = seeds_of(spark, sf)
    return palette.paint_order(seeds).select("image_id", "k", "paint_order")


@query
def n01_blur(spark, sf):
    return neighborhood.blur(fixtures.thumbs(spark, sf).withColumn("luma", s.luma()), 3).select("image_id", "x", "y", "luma")


@query
def n02_dilate(spark, sf):
    pixels = fixtures.swatches(spark, sf)
    return neighborhood.dilate(neighborhood.runs(dark_mask(pixels)), neighborhood.images_of(pixels), 2)


@query
def n03_boundary(spark, sf):
    dense = fixtures.swatches(spark, sf).select("image_id", F.lit(0).alias("layer_id"), "x", "y", (s.opaque() & (s.luma() < 100)).alias("ink"))
    return neighborhood.boundary(dense).select("image_id", "x", "y", "ink")


def thumb_components(spark, sf):
    pixels = fixtures.thumbs(spark, sf)
    images = neighborhood.images_of(pixels)
    mask = pixels.where(s.luma() >= 100).select("image_id", F.lit(0).alias("layer_id"), "x", "y")
    return images, neighborhood.runs(mask)


@query
def c01_components(spark, sf):
    images, spans = thumb_components(spark, sf)
    return components.label(spans, images).select("image_id", "comp_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


@query
def c02_facts(spark, sf):
    images, spans = thumb_components(spark, sf)
    out = components.facts(components.label(spans, images), images)
    return out.select("image_id", "comp_id", "area", "touches_border", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query
def c03_specks(spark, sf):
    images, spans = thumb_components(spark, sf)
    return neighborhood.pixels_of(components.without_specks(spans, images, 4)).select("image_id", "x", "y")


@query
def c04_holes(spark, sf):
    images, spans = thumb_components(spark, sf)
    return neighborhood.pixels_of(components.filled(spans, images, spans.select("image_id", "layer_id").distinct(), 4)).select("image_id", "x", "y")


@query
def c05_background(spark, sf):
    return components.background(fixtures.thumbs(spark, sf), 60)


@query
def c06_mainland(spark, sf):
    images, spans = thumb_components(spark, sf)
    return components.mainland_and_islands(components.facts(components.label(spans, images), images), 2).select("image_id", "comp_id", "area", "role")


@query
def b01_even_sample(spark, sf):
    points = fixtures.swatches(spark, sf).select("image_id", (F.col("y").cast("long") * 24 + F.col("x")).alias("idx"))
    return bridges.sampled(points, ["image_id"], ["idx"], F.lit(20))


@query
def b04_sectors(spark, sf):
    pixels = fixtures.swatches(spark, sf)
    k = bridges.sector(F.col("x"), F.col("y"), F.lit(11.5), F.lit(11.25), bridges.sector_centres(3, False))
    return pixels.select("image_id", "x", "y", k.alias("sector"))


@query
def b05_line_pixels(spark, sf):
    ends = fixtures.thumbs(spark, sf).where("x = 0").select("image_id", F.lit(0).alias("sx"), F.col("y").alias("sy"), (F.col("r") % 40).alias("tx"), (F.col("g") % 40).alias("ty"))
    return bridges.line_pixels(ends).groupBy("image_id", "sx", "sy", "tx", "ty").agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query
def b07_crossings(spark, sf):
    """Pairs of ring edges of neighbouring contours of a document that cross."""
    return vector.crossings(fixtures.rings(spark, sf), 0.01)


def stack_inputs(spark, sf):
    """The two darkest layers of every swatch, and the layer over them as their cover."""
    pixels = fixtures.swatches(spark, sf)
    masks = components._saved(band_masks(spark, pixels))
    return masks.where("layer_id < 2"), neighborhood.images_of(pixels), masks.where("layer_id = 2").select("image_id", "x", "y")


@query
def b02_b03_targets(spark, sf):
    mask, images, _ = stack_inputs(spark, sf)
    return bridges.candidates(mask, images, bridges=3, each=8, least=2)


@query
def b06_coverage(spark, sf):
    mask, images, upper = stack_inputs(spark, sf)
    found = bridges.covered_candidates(mask, images, upper, bridges=3, each=8, least=2, mainland_only=True)
    return found.select("image_id", "layer_id", "island", "sector", "sx", "sy", "tx", "ty", F.round("coverage", 6).alias("coverage"))


@query
def b08_best_candidates(spark, sf):
    mask, images, upper = stack_inputs(spark, sf)
    found = bridges.covered_candidates(mask, images, upper, bridges=3, each=8, least=2, mainland_only=True)
    return bridges.best_candidates(found).select("image_id", "layer_id", "island", "sector", "sx", "sy", "tx", "ty", "tier", F.round("score", 6).alias("score"))


def thumb_candidates(spark, sf, covered=True):
    """Bridge candidates of all four layers of every small picture, with the lightest layer as their cover."""
    pixels = fixtures.thumbs(spark, sf)
    masks = band_masks(spark, pixels)
    upper = masks.where("layer_id = 3").select("image_id", "x", "y") if covered else None
    find = bridges.covered_candidates if covered else lambda masks, images, _, **options: bridges.candidates(masks, images, **options)
    return find(masks, neighborhood.images_of(pixels), upper, bridges=3, each=8, least=2)


@query
def b02_b03_thumb_targets(spark, sf):
    return thumb_candidates(spark, sf, covered=False)


@query
def b06_thumb_coverage(spark, sf):
    return thumb_candidates(spark, sf).select("image_id", "layer_id", "island", "sector", "sx", "sy", "tx", "ty", "target", F.round("coverage", 6).alias("coverage"))


@query
def b08_thumb_best(spark, sf):
    best = bridges.best_candidates(thumb_candidates(spark, sf))
    return best.select("image_id", "layer_id", "island", "sector", "sx", "sy", "tx", "ty", "target", "tier", F.round("score", 6).alias("score"))


@query
def b05_line_members(spark, sf):
    """Every pixel of lines between points of every small picture."""
    ends = fixtures.thumbs(spark, sf).where("x = 0").select("image_id", F.lit(0).alias("sx"), F.col("y").alias("sy"), (F.col("r") % 20).alias("tx"), (F.col("g") % 20).alias("ty"))
    return bridges.line_pixels(ends)


@query
def b09_b16_choice(spark, sf):
    mask, images, upper = stack_inputs(spark, sf)
    _, listed = bridges.smart_bridges(mask, images, upper, 2, bridges=3, each=8, least=2)
    return listed.select("image_id", "layer_id", "island", "sector", "sx", "sy", "tx", "ty", "selected", F.round("score", 6).alias("score"))


def ink_of(done: DataFrame, before: DataFrame) -> DataFrame:
    """Pixels of every (image_id, layer_id) of ``before`` that ``done`` has left, 0 where it has none."""
    keys = ["image_id", "layer_id"]
    both = before.select(*keys, F.lit(None).cast("int").alias("left")).union(done.select(*keys, F.lit(1).alias("left")))
    return both.groupBy(*keys).agg(F.count("left").alias("ink"))


@query
def b10_erased(spark, sf):
    mask, images, upper = stack_inputs(spark, sf)
    done, _ = bridges.smart_bridges(mask, images, upper, 2, bridges=3, each=8, least=2)
    return ink_of(done, mask)


@query
def b11_b13_simple_plan(spark, sf):
    mask, images, _ = stack_inputs(spark, sf)
    return bridges.simple_bridges(mask, images, 2).fillna(-1, "target")  # -1: the mainland


@query
def b14_statistics(spark, sf):
    mask, images, upper = stack_inputs(spark, sf)
    _, listed = bridges.smart_bridges(mask, images, upper, 2, bridges=3, each=8, least=2)
    return bridges.statistics(listed, mask.select("image_id", "layer_id").distinct())


@query
def b15_bridged_stack(spark, sf):
    pixels = fixtures.thumbs(spark, sf)
    masks = components._saved(band_masks(spark, pixels))
    done, _ = bridges.bridge_stack(masks, neighborhood.images_of(pixels), [0, 1, 2, 3])
    return ink_of(done, masks)


def svgs(spark, sf):
    """Ring contours as documents of one path each."""
    found = vector.ring_arrays(fixtures.rings(spark, sf)).select("doc_id", "contour_id", vector.path_of(F.col("points")).alias("d"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("contour_id", "d"))), lambda p: F.concat(F.lit('<path d="'), p["d"], F.lit('" fill="black"/>'))), "")
    head = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000" width="1000" height="1000">'
    return found.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("svg"))


@query
def v01_paths(spark, sf):
    return vector.paths(svgs(spark, sf))


@query
def v02_flatten(spark, sf):
    return vector.flatten(vector.paths(svgs(spark, sf))).select("doc_id", "contour_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query
def v03_areas(spark, sf):
    return vector.areas(fixtures.rings(spark, sf)).select("doc_id", "contour_id", F.round("area", 6).alias("area"))


@query
def v04_mainland(spark, sf):
    return vector.roles(vector.areas(fixtures.rings(spark, sf))).select("doc_id", "contour_id", "role")


@query
def v05_simplified(spark, sf):
    return vector.simplify(fixtures.rings(spark, sf), 12.0).groupBy("doc_id", "contour_id").agg(F.count("*").alias("n"))


@query
def v06_feet(spark, sf):
    f = vector.candidates(fixtures.rings(spark, sf))
    return f.groupBy("doc_id", "contour_id").agg(F.count("*").alias("n"), F.min(F.round("d2", 6)).alias("d2"))


@query
def v07_v08_shortest_bridges(spark, sf):
    rings = fixtures.rings(spark, sf)
    best = vector.shortest_clear(rings)
    return best.select("doc_id", "contour_id", "seq", "edge", F.round("d2", 6).alias("d2"))


@query
def v09_rectangles(spark, sf):
    best = vector.shortest(vector.candidates(fixtures.rings(spark, sf))).withColumn("p", vector.bridge_rectangle(3)).where("p is not null")
    return best.select("doc_id", "contour_id", *(F.round(F.col("p")[k][c], 6).alias(f"{c}{k}") for k in range(4) for c in "xy"))


@query
def v10_bridged_paths(spark, sf):
    return vector.bridged_paths(fixtures.rings(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_paths"), F.count_if(F.col("place").startswith("x")).alias("n_bridges"))


@query
def v11_path_strings(spark, sf):
    third = fixtures.rings(spark, sf).withColumn("x", F.col("x") / 8).withColumn("y", F.col("y") / 4)
    return vector.ring_arrays(third).select("doc_id", "contour_id", vector.path_of(F.col("points")).alias("d"))


@query
def v12_documents(spark, sf):
    rings = fixtures.rings(spark, sf)
    shapes = vector.ring_arrays(rings).select("doc_id", F.lpad(F.col("contour_id").cast("string"), 19, "0").alias("place"), vector.path_of(F.col("points")).alias("d"))
    return vector.documents(shapes, svgs(spark, sf), "#123456")


@query
def e01_runs(spark, sf):
    return neighborhood.runs(band_masks(spark, fixtures.swatches(spark, sf)))


@query
def e02_mask_svg(spark, sf):
    pixels = fixtures.thumbs(spark, sf)
    boxes = export.rectangles(neighborhood.runs(band_masks(spark, pixels)))
    return export.mask_svg(boxes, neighborhood.images_of(pixels), compose.stack_colour(F.col("layer_id")))


@query
def e03_outlines(spark, sf):
    """Every corner of the outline rings of every dark mask."""
    rings = export.outlines(dark_mask(fixtures.swatches(spark, sf)))
    return rings.withColumn("x", F.col("x").cast("int")).withColumn("y", F.col("y").cast("int"))


@query
def e04_raster_marks(spark, sf):
    pixels = fixtures.thumbs(spark, sf)
    return export.with_raster_marks(dark_mask(pixels), neighborhood.images_of(pixels)).select("image_id", "x", "y")


@query
def e05_svg_marks(spark, sf):
    pixels = fixtures.thumbs(spark, sf)
    images = neighborhood.images_of(pixels)
    made = export.mask_svg(export.rectangles(neighborhood.runs(dark_mask(pixels))), images, F.lit("#000000")).join(images, "image_id")
    return made.select("image_id", export.with_svg_marks(F.col("svg"), F.col("width"), F.col("height")).alias("svg"))


@query
def e06_physical_size(spark, sf):
    h = export.linked_height(F.col("image_id") % 90 + 10, F.lit(8), F.lit(6))
    pixels = fixtures.thumbs(spark, sf)
    boxes = export.rectangles(neighborhood.runs(dark_mask(pixels)))
    made = export.mask_svg(boxes, neighborhood.images_of(pixels), F.lit("#000000"))
    return made.select("image_id", h.alias("height_mm"), F.substring_index(export.with_size(F.col("svg"), F.col("image_id") % 90 + 10, h), "><rect", 1).alias("head"))


@query
def e06_linked_width(spark, sf):
    """Widths linked to heights of 10 to 99 mm, of posters of different shapes."""
    sizes = neighborhood.images_of(fixtures.posters(spark, sf))
    heights = sizes.withColumn("height_mm", F.explode(F.sequence(F.lit(10), F.lit(99))))
    return heights.select("image_id", "height_mm", export.linked_width(F.col("height_mm"), F.col("width"), F.col("height")).alias("width_mm"))


@query
def x01_composite(spark, sf):
    return tone_preview(spark, sf, fixtures.swatches(spark, sf))


@query
def x02_stack_colours(spark, sf):
    return fixtures.edit_events(spark, sf).select("event_id", compose.stack_colour(F.col("event_id")).alias("color"))


@query
def x03_merged_layers(spark, sf):
    return compose.merge_layers(band_masks(spark, fixtures.thumbs(spark, sf)), 0, 1, 0)


@query
def x04_duplicated_layer(spark, sf):
    return compose.duplicate_layer(band_masks(spark, fixtures.thumbs(spark, sf)), 0, 9)


@query
def r02_bursts(spark, sf):
    out = live.bursts(fixtures.edit_events(spark, sf), "6 hours")
    return out.select("session_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "n_events", "last_value")


@query
def r03_folded_state(spark, sf):
    state = live.folded(fixtures.edit_events(spark, sf))
    return state.withColumn("threshold", F.coalesce("threshold", F.lit(-1))).withColumn("color", F.coalesce("color", F.lit(-1)))


@query
def s03_data_url_round_trip(spark, sf):
    """PNG, data URL and back."""
    pixels = fixtures.thumbs(spark, sf)
    made = raster_io.to_png(pixels.withColumn("layer_id", F.lit(0)), neighborhood.images_of(pixels)).withColumn("d", raster_io.decode_url(raster_io.encode_url(F.col("png"))))
    return made.select("image_id", F.col("d.mime").alias("mime"), (F.col("d.bytes") == F.col("png")).alias("same"), F.hex(F.substring("png", 17, 8)).alias("size"))


def through_files(spark: SparkSession, made: DataFrame) -> DataFrame:
    """(name, png) written as files to the shared folder and read back as pixels."""
    folder = components.shared_path(spark)
    png.save_pngs(made, folder)
    return png.read_pngs(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))


@query
def s01_s04_png_pixels(spark, sf):
    """Small pictures as PNG files, read by the data source: pixels with luma."""
    pixels = fixtures.thumbs(spark, sf)
    made = raster_io.to_png(pixels.withColumn("layer_id", F.lit(0)), neighborhood.images_of(pixels))
    back = through_files(spark, made.select(F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "png"))
    return back.select(F.split("name", r"\.")[0].cast("long").alias("image_id"), "x", "y", "r", "g", "b", "a", s.luma().cast("int").alias("luma"))


@query
def s08_layer_pngs(spark, sf):
    """A PNG file for each layer of every small picture in the pixels' own colours, read back: what is inked."""
    pixels = fixtures.thumbs(spark, sf)
    drawn = band_masks(spark, pixels).join(pixels.select("image_id", "x", "y", "r", "g", "b"), ["image_id", "x", "y"]).withColumn("a", F.lit(255))
    made = raster_io.to_png(drawn, neighborhood.images_of(pixels))
    back = through_files(spark, made.select(F.concat_ws("-", "image_id", F.concat(F.col("layer_id").cast("string"), F.lit(".png"))).alias("name"), "png"))
    part = lambda k: F.split("name", "[-.]")[k]
    return back.where("a > 0").select(part(0).cast("long").alias("image_id"), part(1).cast("int").alias("layer_id"), "x", "y", "r", "g", "b")


@query
def s06_rewritten_layer(spark, sf):
    """All layers saved, layer 1 saved anew as its mirror image, and two layers read back."""
    masks, folder = band_masks(spark, fixtures.thumbs(spark, sf)), components.shared_path(spark)
    raster_io.save_layers(masks, folder)
    raster_io.save_layers(masks.where("layer_id = 1").withColumn("x", 7 - F.col("x")), folder)
    return raster_io.stored_layers(spark, folder, 1, 2).select("image_id", "layer_id", "x", "y")


@query
def r01_arriving_pictures(spark, sf):
    """Small pictures that arrive in batches, and the number of colours of each."""
    pixels, folder = fixtures.thumbs(spark, sf), components.shared_path(spark)
    pixels.repartition(3, "image_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.arriving(stream, palette.estimate_count, f"{folder}/out", f"{folder}/c").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("image_id", "n_colors")


@query
def r04_late_edits(spark, sf):
    """Edits replayed in five batches, event_id modulo 5, each judged by a watermark of three days behind the batches before."""
    edits, folder = fixtures.edit_events(spark, sf), components.shared_path(spark)
    typed = edits.withColumn("ts", F.col("ts").cast("timestamp")).select("session_id", "event_id", "ts")
    for k in range(5):  # files are read in the order in which they were written
        typed.where(F.col("event_id") % 5 == k).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    live.judged(stream, "3 days", f"{folder}/out", f"{folder}/c").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("session_id", "event_id", "accepted")


@query
def t01_preset_colours(spark, sf):
    """How many opaque pixels are at or over each limit, by the preset's colour."""
    lit = fixtures.thumbs(spark, sf).where(s.opaque()).groupBy(s.luma().alias("luma")).count()
    table = tone.presets(spark, [*range(2, 13), 14])
    return lit.join(F.broadcast(table), F.col("luma") >= F.col("upper")).groupBy("n_layers", "layer_id", "color").agg(F.sum("count").alias("n_over"))


@query
def x01_canvas(spark, sf):
    """The whole canvas in the stack's colours, second layers hidden in every third picture; transparent where nothing is drawn."""
    pixels = fixtures.thumbs(spark, sf)
    layers = pixels.select("image_id").distinct().join(F.broadcast(limits(spark))).select("image_id", "layer_id", F.col("layer_id").alias("paint_order"), ((F.col("layer_id") != 1) | (F.col("image_id") % 3 != 0)).alias("visible"))
    drawn = compose.composite(band_masks(spark, pixels), compose.shown_colours(layers, "realistic"))
    return compose.on_canvas(pixels, drawn).groupBy("image_id", F.coalesce("color", F.lit("transparent")).alias("color")).agg(F.count("*").alias("n_pixels"))


def described(stack: workloads.Stack, masks: DataFrame) -> DataFrame:
    ink = masks.groupBy("image_id", "layer_id").agg(F.count("*").alias("ink"))
    return stack.layers.join(ink, ["image_id", "layer_id"], "left").withColumn("ink", F.coalesce("ink", F.lit(0)))


@query
def w1_realistic_layers(spark, sf):
    """Blur, bands, clean-up, names, limits and mean colours of every picture's tone layers."""
    stack = workloads.tone_stack(fixtures.thumbs(spark, sf), FOUR, blur=2, cleanup=3)
    return described(stack, stack.masks).select("image_id", "layer_id", "name", "description", "lower", "upper", "color", "ink")


@query
def w1_realistic_stack(spark, sf):
    """The same with bridges: ink before and after, and how many bridges there are."""
    stack = workloads.tone_stack(fixtures.thumbs(spark, sf), FOUR, blur=2, cleanup=3, bridge=True)
    after = stack.masks.groupBy("image_id", "layer_id").agg(F.count("*").alias("left"))
    made = bridges.statistics(stack.listed, stack.layers.select("image_id", "layer_id"))
    whole = described(stack, stack.clean).join(after, ["image_id", "layer_id"], "left").join(made, ["image_id", "layer_id"])
    return whole.select("image_id", "layer_id", "name", "color", "ink", F.coalesce("left", F.lit(0)).alias("ink_left"), "island_count", "bridges_created")


@query
def w2_colour_layers(spark, sf):
    """Palette, background, nearest colours, paint order, bleed and metadata of every picture's colour layers."""
    stack = workloads.colour_stack(fixtures.thumbs(spark, sf), 3)
    return described(stack, stack.masks).select("image_id", "layer_id", "name", "description", "color", "ink")


@query
def w2_colour_stack(spark, sf):
    """As many colours as estimated, with bridges and the composite: pixels of each colour."""
    pixels = fixtures.thumbs(spark, sf)
    stack = workloads.colour_stack(pixels, None, bridge=True, least=1)
    drawn = compose.composite(stack.masks, compose.shown_colours(stack.layers, "cartoon"))
    return compose.on_canvas(pixels, drawn).groupBy("image_id", F.coalesce("color", F.lit("transparent")).alias("color")).agg(F.count("*").alias("n_pixels"))


@query
def w3_bridged_documents(spark, sf):
    """Documents read, bridged and written."""
    return workloads.vector_documents(svgs(spark, sf), 3, "#123456", 0)


@query
def w3_simplified_documents(spark, sf):
    """The same with bridges between simplified contours: paths of each document."""
    done = workloads.vector_documents(svgs(spark, sf), 3, "#123456", 12.0)
    return done.select("doc_id", F.regexp_count("svg", F.lit("<path")).alias("n_paths"))


def state_events(spark, sf):
    """Edits, of which those of the blur set layer counts (2 to 14) and modes too."""
    edits = fixtures.edit_events(spark, sf)
    blur, third = F.col("setting") == "blur", F.pmod(F.col("value"), F.lit(3))
    setting = F.when(blur & (third == 0), "layers").when(blur & (third == 1), "mode").otherwise(F.col("setting"))
    value = F.when(blur & (third == 0), F.pmod(F.col("value"), F.lit(13)) + 2).when(blur & (third == 1), F.pmod(F.col("event_id"), F.lit(2))).otherwise(F.col("value"))
    return edits.withColumns({"setting": setting, "value": value.cast("int")})


def estimates_of(events: DataFrame) -> DataFrame:
    return events.select("session_id").distinct().where("session_id % 2 = 0").select("session_id", F.pmod("session_id", F.lit(19)).cast("int").alias("k")).select("session_id", (F.col("k") + 2).alias("n_colors"))


@query
def r03_settings(spark, sf):
    events = state_events(spark, sf)
    return live.settings(events, estimates_of(events))


@query
def r03_layer_state(spark, sf):
    events = state_events(spark, sf)
    return live.layer_state(events, tone.presets(spark, list(range(2, 22))), estimates_of(events))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tone_preview(spark, sf_dir, fixtures.thumbs(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
