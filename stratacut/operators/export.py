"""Masks as SVG rectangles and outline rings; registration marks; physical sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacut.functions.scalars import rounded
from stratacut.operators import batches
from stratacut.operators.components import _saved

CORNERS = "image_id long, layer_id int, contour_id long, seq int, x double, y double"


def rectangles(spans: DataFrame) -> DataFrame:
    """(image_id, layer_id, x0, x1, y0, y1): equal runs of successive rows as one rectangle."""
    w = Window.partitionBy("image_id", "layer_id", "x0", "x1").orderBy("y")
    return spans.withColumn("_g", F.col("y") - F.row_number().over(w)).groupBy("image_id", "layer_id", "x0", "x1", "_g").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).drop("_g")


def mask_svg(boxes: DataFrame, images: DataFrame, fill: Column) -> DataFrame:
    """(image_id, layer_id, svg): a white ground and one path of rectangles in the layer's colour."""
    text = F.concat(F.lit("M "), F.col("x0").cast("string"), F.lit(" "), F.col("y0").cast("string"), F.lit(" H "), (F.col("x1") + 1).cast("string"), F.lit(" V "), (F.col("y1") + 1).cast("string"), F.lit(" H "), F.col("x0").cast("string"), F.lit(" Z"))
    joined = boxes.groupBy("image_id", "layer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", text.alias("t")))), lambda s: s["t"]), " ").alias("d")).join(images, "image_id")
    w, h = F.col("width").cast("string"), F.col("height").cast("string")
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), w, F.lit(" "), h, F.lit('" width="'), w, F.lit('" height="'), h, F.lit('"><rect width="'), w, F.lit('" height="'), h, F.lit('" fill="white"/><path d="'), "d", F.lit('" fill="'), fill, F.lit('"/></svg>'))
    return joined.select("image_id", "layer_id", svg.alias("svg"))


def sides(mask: DataFrame) -> DataFrame:
    """(image_id, layer_id, kind, x, y, tx, ty): maximal straight sides of a mask, ink to the right of the way from (x, y) to (tx, ty).

    kind: 0 to the right over ink, 1 down, 2 to the left under ink, 3 up.
    """
    row, column = Window.partitionBy("image_id", "layer_id", "y").orderBy("x"), Window.partitionBy("image_id", "layer_id", "x").orderBy("y")
    bare = lambda near, own: F.coalesce(near != own, F.lit(True))
    x, y = F.col("x"), F.col("y")
    flat = mask.select("image_id", "layer_id", "x", "y").withColumn("left", bare(F.lag("x").over(row), x - 1)).withColumn("right", bare(F.lead("x").over(row), x + 1))
    both = flat.withColumn("up", bare(F.lag("y").over(column), y - 1)).withColumn("down", bare(F.lead("y").over(column), y + 1))
    unit = lambda kind, line, along: F.struct(F.lit(kind).alias("kind"), line.alias("line"), along.alias("along"))
    found = F.array(F.when(F.col("up"), unit(0, y, x)), F.when(F.col("right"), unit(1, x + 1, y)), F.when(F.col("down"), unit(2, y + 1, x)), F.when(F.col("left"), unit(3, x, y)))
    units = both.select("image_id", "layer_id", F.explode(F.array_compact(found)).alias("e")).select("image_id", "layer_id", "e.*")
    key = ["image_id", "layer_id", "kind", "line"]
    runs = units.withColumn("_g", F.col("along") - F.row_number().over(Window.partitionBy(*key).orderBy("along")))
    spans = runs.groupBy(*key, "_g").agg(F.min("along").alias("a"), (F.max("along") + 1).alias("b"))
    kind, level = F.col("kind"), F.col("kind") % 2 == 0
    begin, end = F.when(kind < 2, F.col("a")).otherwise(F.col("b")), F.when(kind < 2, F.col("b")).otherwise(F.col("a"))
    return spans.select("image_id", "layer_id", "kind", F.when(level, begin).otherwise(F.col("line")).alias("x"), F.when(level, F.col("line")).otherwise(begin).alias("y"),
                        F.when(level, end).otherwise(F.col("line")).alias("tx"), F.when(level, F.col("line")).otherwise(end).alias("ty"))


def outlines(mask: DataFrame, most: int = 65_536) -> DataFrame:
    """(image_id, layer_id, contour_id, seq, x, y): corners of the closed rings around a mask's pixels, ink to the right.

    Each side is followed by the one that begins where it ends; where two rings touch, the right turn keeps to the same 4-connected
    ink. Rings are numbered by their first corner (topmost, then leftmost), which is their seq 0. Masks of at most ``most`` pixels are
    dealt once and worked out many at a time; larger ones by windows and rounds, so no task has one whole.
    """
    layer = ["image_id", "layer_id"]
    pixels = _saved(mask.select(F.col("image_id").cast("long"), F.col("layer_id").cast("int"), F.col("x").cast("int"), F.col("y").cast("int")).dropna())
    large = pixels.groupBy(*layer).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*layer)
    if large.isEmpty():
        return batches.by_groups(pixels, layer, ["y", "x"], _traced, CORNERS)
    large = _saved(large)
    few = batches.by_groups(pixels.join(large, layer, "left_anti"), layer, ["y", "x"], _traced, CORNERS)
    return few.unionByName(_outlines_by_rounds(pixels.join(large, layer, "left_semi")))


def _traced(rows: pd.DataFrame) -> pd.DataFrame:
    """Corners of the rings of whole masks; ``rows`` are sorted by mask, y and x."""
    image, layer, x, y = (rows[c].to_numpy() for c in ("image_id", "layer_id", "x", "y"))
    x, y = x.astype(np.int64), y.astype(np.int64)
    mask = np.zeros(len(rows), np.int64)
    mask[batches.starts(rows, ["image_id", "layer_id"])[1:]] = 1
    mask = np.cumsum(mask)
    left, top = x.min(), y.min()
    width, height = x.max() - left + 2, y.max() - top + 2
    at = lambda m, x, y: (m * height + y - top) * width + x - left
    own = at(mask, x, y)
    new = np.append(True, own[1:] != own[:-1])
    own, x, y, mask, first = own[new], x[new], y[new], mask[new], np.flatnonzero(new)

    def among(some: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where ``wanted`` are in sorted ``some``; -1: nowhere."""
        k = np.minimum(np.searchsorted(some, wanted), len(some) - 1)
        return np.where(some[k] == wanted, k, -1)

    # sides of single pixels: 0 to the right over ink, 1 down, 2 to the left under ink, 3 up. A column and a row more than the
    # pixels have keep neighbours of different rows and masks apart
    bare = lambda dx, dy: among(own, own + dy * width + dx) < 0
    parts = [(bare(0, -1), 0, 0, 0), (bare(1, 0), 1, 0, 1), (bare(0, 1), 1, 1, 2), (bare(-1, 0), 0, 1, 3)]
    m, sx, sy = (np.concatenate([v[b] + d for b, v, d in some]) for some in ([(b, mask, 0) for b, *_ in parts], [(b, x, d) for b, d, _, _ in parts], [(b, y, d) for b, _, d, _ in parts]))
    kind = np.repeat(np.arange(4), [b.sum() for b, *_ in parts])
    code = at(m, sx, sy) * 4 + kind
    order = np.argsort(code)
    code, m, sx, sy, kind = code[order], m[order], sx[order], sy[order], kind[order]
    tx, ty = sx + np.array([1, 0, -1, 0])[kind], sy + np.array([0, 1, 0, -1])[kind]
    spot = at(m, tx, ty) * 4
    then = np.full(len(code), -1)
    for turn in (3, 0, 1):  # a right turn before going on, and that before a left turn
        k = among(code, spot + (kind + turn) % 4)
        then = np.where(k >= 0, k, then)
    # corners: sides that don't go on in the direction of the one before; a corner's next is the first one after it
    corner = np.zeros(len(code), bool)
    corner[then] = kind[then] != kind
    jump = then
    while not corner[jump].all():
        jump = np.where(corner[jump], jump, jump[jump])
    keep = np.flatnonzero(corner)
    to = np.cumsum(corner)[jump[keep]] - 1
    m, sx, sy = m[keep], sx[keep], sy[keep]
    # by pointer jumping: the least corner of a ring, and how far ahead it is
    least, ahead, jump, span = np.arange(len(keep)), np.zeros(len(keep), np.int64), to, 1
    while True:
        there = least[jump]
        better = there < least
        if not better.any():
            break
        least, ahead = np.where(better, there, least), np.where(better, ahead[jump] + span, ahead)
        jump, span = jump[jump], 2 * span
    n = np.bincount(least, minlength=len(keep))
    begins = np.flatnonzero(n)
    before = np.searchsorted(m[begins], m[begins])
    number = np.zeros(len(keep), np.int64)
    number[begins] = np.arange(len(begins)) - before
    some = first[np.searchsorted(mask, m)]
    return pd.DataFrame({"image_id": image[some], "layer_id": layer[some], "contour_id": number[least], "seq": ((n[least] - ahead) % n[least]).astype(np.int32), "x": sx.astype(float), "y": sy.astype(float)})


def _outlines_by_rounds(mask: DataFrame) -> DataFrame:
    """Rings are ranked by pointer jumping: each round a side knows the first one among twice as many sides ahead, and how far that
    is, until nothing changes. So no ring and no mask has to fit one task; rounds are the logarithm of the longest ring's corners.
    """
    layer = ["image_id", "layer_id"]
    spot = lambda x, y: (F.col(y).cast("long") * (1 << 24) + F.col(x)) * 4
    found = sides(mask).withColumn("node", spot("x", "y") + F.col("kind"))
    turned = lambda by: spot("tx", "ty") + (F.col("kind") + by) % 4
    begins = found.select(*layer, F.col("node").alias("to"))
    options = found.select(*layer, "node", "x", "y", F.explode(F.array(F.struct(F.lit(0).alias("order"), turned(1).alias("to")), F.struct(F.lit(1).alias("order"), turned(3).alias("to")))).alias("o"))
    linked = options.select(*layer, "node", "x", "y", F.col("o.order").alias("order"), F.col("o.to").alias("to")).join(begins, [*layer, "to"])
    nexts = linked.groupBy(*layer, "node", "x", "y").agg(F.min_by("to", "order").alias("jump"))
    state, span = _saved(nexts.withColumn("least", F.col("node")).withColumn("ahead", F.lit(0).cast("long"))), 1
    while True:
        far = state.select(*layer, F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("least").alias("there"), F.col("ahead").alias("way"))
        better = F.col("there") < F.col("least")
        step = state.join(far, [*layer, "jump"]).select(*layer, "node", "x", "y", F.col("further").alias("jump"), F.least("least", "there").alias("least"), F.when(better, F.col("way") + span).otherwise(F.col("ahead")).alias("ahead"), better.alias("moved"))
        new = _saved(step)
        state, span = new.drop("moved"), 2 * span
        if new.where("moved").isEmpty():
            break
    rings = state.groupBy(*layer, "least").agg(F.count("*").alias("n"))
    numbered = rings.withColumn("contour_id", F.row_number().over(Window.partitionBy(*layer).orderBy("least")).cast("long") - 1)
    ranked = state.join(numbered, [*layer, "least"])
    return ranked.select(*layer, "contour_id", ((F.col("n") - F.col("ahead")) % F.col("n")).cast("int").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def with_raster_marks(mask: DataFrame, images: DataFrame, arm: int = 14, width: int = 3, margin: int = 24) -> DataFrame:
    """(image_id, layer_id, x, y): masks on a canvas with ``margin`` on every side and crosses in its corners.

    Some 700 pixels of marks a layer are far more than a small mask, so they are made without repeats where they are made: pixels of an
    earlier bar, or of the mask under a bar, are left out by comparing coordinates. Only the mask's own pixels are shuffled.
    """
    half = width // 2
    m = F.lit(margin / 2)
    far_x, far_y = F.col("w") - m, F.col("h") - m
    centres = [(m, m), (far_x, m), (m, far_y), (far_x, far_y)]
    size = images.select("image_id", (F.col("width") + 2 * margin).alias("w"), (F.col("height") + 2 * margin).alias("h"))
    # bars as first and last column and row: level and upright ones of each cross, in turn
    bars = []
    for cx, cy in centres:
        x, y = rounded(cx).cast("int"), rounded(cy).cast("int")
        bars += [(rounded(cx - arm).cast("int"), rounded(cx + arm).cast("int"), y - half, y + half), (x - half, x + half, rounded(cy - arm).cast("int"), rounded(cy + arm).cast("int"))]
    under = lambda b: F.col("x").between(b[0], b[1]) & F.col("y").between(b[2], b[3])
    marked = F.lit(False)
    for b in bars:
        marked = marked | under(b)
    keys = ["image_id", "layer_id"]
    moved = mask.select(*keys, (F.col("x") + margin).alias("x"), (F.col("y") + margin).alias("y")).distinct()
    ink = moved.join(size, "image_id").where(~marked).select(*keys, "x", "y")
    listed = F.array(*(F.struct(F.lit(k).alias("k"), *(v.alias(n) for n, v in zip(("x0", "x1", "y0", "y1"), b, strict=True))) for k, b in enumerate(bars)))
    layers = mask.select(*keys).distinct().join(size, "image_id").withColumn("b", F.explode(listed))
    points = layers.withColumn("x", F.explode(F.sequence("b.x0", "b.x1"))).withColumn("y", F.explode(F.sequence("b.y0", "b.y1")))
    before = F.lit(False)
    for k, b in enumerate(bars):
        before = before | ((F.col("b.k") > k) & under(b))
    return ink.unionByName(points.where(~before & F.expr("x >= 0 and x < w and y >= 0 and y < h")).select(*keys, "x", "y"))


def with_size(svg: Column, width_mm: Column, height_mm: Column) -> Column:
    """The document with its width and height in millimetres."""
    out = F.regexp_replace(svg, F.lit(r'^(.*?<svg[^>]*)\swidth="[^"]*"'), F.concat(F.lit('$1 width="'), width_mm.cast("string"), F.lit('mm"')))
    return F.regexp_replace(out, F.lit(r'^(.*?<svg[^>]*)\sheight="[^"]*"'), F.concat(F.lit('$1 height="'), height_mm.cast("string"), F.lit('mm"')))


def linked_height(width_mm: Column, width: Column, height: Column) -> Column:
    return rounded(width_mm / (width / height)).cast("long")


def linked_width(height_mm: Column, width: Column, height: Column) -> Column:
    return rounded(height_mm * (width / height)).cast("long")


def file_name(layer_id: Column, mode: Column | None = None) -> Column:
    """The name of a layer's document in a whole export, or, with its ``mode``, of one saved by itself."""
    number = (layer_id + 1).cast("string")
    if mode is None:
        return F.concat(F.lit("stencil-layer-"), F.lpad(number, 2, "0"), F.lit(".svg"))
    return F.concat(F.lit("stencil-"), mode, F.lit("-layer-"), number, F.lit(".svg"))


def save_documents(found: DataFrame, path: str) -> None:
    """Write (file, svg) as text, a folder for each file name."""
    found.select("file", "svg").write.mode("overwrite").partitionBy("file").text(path)


def with_svg_marks(svg: Column, width: Column, height: Column, arm: int = 12, thick: int = 2, margin: int = 20, color: str = "black") -> Column:
    """A document of ``mask_svg`` on a canvas with ``margin`` on every side: content moved, a cross in each corner."""
    w, h = width + 2 * margin, height + 2 * margin
    text = lambda v: F.regexp_replace(v.cast("double").cast("string"), r"\.0$", "")
    m = F.lit(margin / 2)

    def stroke(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        parts: list[Column] = []
        for name, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)):
            parts += [F.lit(f'{"<line " if name == "x1" else " "}{name}="'), text(v), F.lit('"')]
        return F.concat(*parts, F.lit(f' stroke="{color}" stroke-width="{thick}" stroke-linecap="round"/>'))

    marks = [stroke(*ends) for cx, cy in ((m, m), (w - m, m), (m, h - m), (w - m, h - m)) for ends in ((cx - arm, cy, cx + arm, cy), (cx, cy - arm, cx, cy + arm))]
    out = F.regexp_replace(svg, F.lit('viewBox="[^"]*"'), F.concat(F.lit('viewBox="0 0 '), text(w), F.lit(" "), text(h), F.lit('"')))
    out = F.regexp_replace(out, F.lit('^(?<a><svg[^>]* width=")[^"]*(?<b>" height=")[^"]*'), F.concat(F.lit("${a}"), text(w), F.lit("${b}"), text(h)))
    out = F.regexp_replace(out, F.lit("^(<svg[^>]*>)<rect[^>]*/>"), F.concat(F.lit('$1<rect width="'), text(w), F.lit('" height="'), text(h), F.lit(f'" fill="white"/><g transform="translate({margin},{margin})">')))
    return F.concat(F.regexp_replace(out, "</svg>$", "</g>"), F.lit('<g id="corner-markers">'), *marks, F.lit("</g></svg>"))
