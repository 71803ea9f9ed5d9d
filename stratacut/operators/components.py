"""Connected components of masks, worked out on runs.

Runs are labelled in strips of rows, many small strips at a time (a call holds some thousand runs, or one strip of one layer of one
picture, however large the picture is); labels of strips are joined along their seams and contracted by min-label rounds. A
component's label is its smallest idx (y * width + x), so it doesn't depend on how the work is split.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacut.operators import batches, small

STRIP = 512
STRIPS = ["image_id", "layer_id", "strip"]
RUNS = "image_id long, layer_id int, y int, x0 int, x1 int, strip int, comp_id long"


def shared_path(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder; where none is set, one below /tmp in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/c-{uuid.uuid4().hex}"


def _saved(df: DataFrame, small: bool = False) -> DataFrame:
    """A table in the shared folder: lineage ends here.

    Such tables are packed to a small part of their size in memory, so that Spark, which goes by files, would send hundreds of
    megabytes through the driver as a small one. They are joined by sorting unless a join asks for a broadcast, or they are known to be ``small``.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    return saved if small else saved.hint("merge")


def _label_strips(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of many whole strips, sorted by strip, y and x0, with the least idx of what each is connected with inside its strip."""
    y, x0, x1, width = (rows[c].to_numpy(np.int64) for c in ("y", "x0", "x1", "width"))
    group = np.zeros(len(rows), np.int64)
    group[batches.starts(rows, STRIPS)] = 1
    # places of runs on one line: rows one after another, with a free one between two strips
    low, across = y.min(initial=0), x1.max(initial=0) + 2
    row = group.cumsum() * (y.max(initial=0) - low + 2) + y - low
    begins, ends = row * across + x0, row * across + x1
    first = np.searchsorted(ends, begins - across, "left")
    n = np.maximum(np.searchsorted(begins, ends - across, "right") - first, 0)
    lower = np.repeat(np.arange(len(rows)), n)
    upper = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)
    root = np.arange(len(rows))
    while True:  # the larger of two roots goes below the smaller, then all look up to their root
        a, b = root[upper], root[lower]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not (root[root] == root).all():
            root = root[root]
    rows["comp_id"] = (y * width + x0)[root]  # the root is the first run in raster order
    return rows[["image_id", "layer_id", "y", "x0", "x1", "strip", "comp_id"]]


def label(spans: DataFrame, images: DataFrame, strip: int = STRIP) -> DataFrame:
    """Runs with comp_id: the smallest idx of the 4-connected component that each is in."""
    cut = spans.join(images.select("image_id", F.col("width").cast("long").alias("width")), "image_id").withColumn("strip", F.floor(F.col("y") / strip).cast("int"))
    local = _saved(batches.by_groups(cut, STRIPS, ["y", "x0"], _label_strips, RUNS))
    above = local.where(F.col("y") % strip == strip - 1).select("image_id", "layer_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("comp_id").alias("a"))
    below = local.where(F.col("y") % strip == 0)
    seams = above.join(below, ["image_id", "layer_id", "y"]).where("a0 <= x1 and x0 <= a1").select("image_id", "layer_id", "a", F.col("comp_id").alias("b")).distinct()
    seams = _saved(seams)
    if seams.isEmpty():
        return local.drop("strip")
    final = _contract(seams)
    return local.join(final.select("image_id", "layer_id", F.col("node").alias("comp_id"), "least"), ["image_id", "layer_id", "comp_id"], "left").select("image_id", "layer_id", "y", "x0", "x1", F.coalesce("least", "comp_id").alias("comp_id"))


def _contract(links: DataFrame, keys: tuple[str, ...] = ("image_id", "layer_id")) -> DataFrame:
    """(keys, node, least) of links (keys, a, b): the least node each is connected with; labels spread and jump until nothing changes."""
    k = list(keys)
    both = _saved(links.select(*k, "a", "b").union(links.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = _saved(both.groupBy(*k, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least")))
    while True:
        around = both.join(state.select(*k, F.col("node").alias("b"), "least"), [*k, "b"]).groupBy(*k, F.col("a").alias("node")).agg(F.min("least").alias("near"))
        jump = state.select(*k, F.col("node").alias("least"), F.col("least").alias("far"))
        step = state.join(around, [*k, "node"], "left").join(jump, [*k, "least"], "left")
        new = _saved(step.select(*k, "node", F.least("least", F.coalesce("near", "least"), F.coalesce("far", "least")).alias("to"), "least"))
        changed = new.where("to <> least").limit(1).count()
        state = new.select(*k, "node", F.col("to").alias("least"))
        if not changed:
            return state


def complement(spans: DataFrame, images: DataFrame, layers: DataFrame) -> DataFrame:
    """Runs of what ``spans`` leave of the canvas, for the layers (image_id, layer_id) given."""
    w = Window.partitionBy("image_id", "layer_id", "y").orderBy("x0")
    rows = layers.join(images, "image_id").select("image_id", "layer_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    edges = rows.select("image_id", "layer_id", "y", F.lit(-1).alias("x0"), F.lit(-1).alias("x1")).union(rows.select("image_id", "layer_id", "y", F.col("width").alias("x0"), F.col("width").alias("x1"))).union(spans.select("image_id", "layer_id", "y", "x0", "x1"))
    gaps = edges.withColumn("to", F.lead("x0").over(w) - 1).where("to is not null").select("image_id", "layer_id", "y", (F.col("x1") + 1).alias("x0"), F.col("to").alias("x1"))
    return gaps.where("x0 <= x1")


def facts(labelled: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, layer_id, comp_id, area, touches_border, cx, cy)."""
    n = F.col("x1") - F.col("x0") + 1
    edge = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width") - 1)
    area = F.sum(n)
    return labelled.join(images, "image_id").groupBy("image_id", "layer_id", "comp_id").agg(area.cast("long").alias("area"), F.bool_or(edge).alias("touches_border"), (F.sum((F.col("x0") + F.col("x1")) * n / 2) / area).alias("cx"), (F.sum(F.col("y") * n) / area).alias("cy"))


def _comps(spans: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    labelled = label(spans, images)
    return labelled, facts(labelled, images)


KEY = ["image_id", "layer_id", "comp_id"]


def without_specks(spans: DataFrame, images: DataFrame, least: int) -> DataFrame:
    """Runs of ink components of at least ``least`` pixels."""
    labelled, known = _comps(spans, images)
    return labelled.join(known.where(F.col("area") >= least), KEY, "left_semi").drop("comp_id")


def filled(spans: DataFrame, images: DataFrame, layers: DataFrame, least: int) -> DataFrame:
    """Runs with inner holes of less than ``least`` pixels filled; holes at the border stay."""
    labelled, known = _comps(complement(spans, images, layers), images)
    holes = labelled.join(known.where((F.col("area") < least) & ~F.col("touches_border")), KEY, "left_semi")
    from stratacut.operators.neighborhood import merged

    return merged(spans.select("image_id", "layer_id", "y", "x0", "x1").unionByName(holes.drop("comp_id")))


def clean(mask: DataFrame, images: DataFrame, least: int) -> DataFrame:
    """Runs of ``mask`` (runs or pixels) without specks, and holes of what is left filled."""
    from stratacut.operators.neighborhood import runs

    def by_strips(images: DataFrame, mask: DataFrame) -> DataFrame:
        spans = mask if "x0" in mask.columns else runs(mask)
        return filled(without_specks(spans, images, least), images, spans.select("image_id", "layer_id").distinct(), least).select("image_id", "layer_id", "y", "x0", "x1")

    return small.either(lambda images, mask: small.cleaned(mask, images, least), by_strips, _saved(images), mask)


def background(pixels: DataFrame, tolerance: int) -> DataFrame:
    """(image_id, x, y): near-white pixels that are connected with the border."""
    from stratacut.functions.scalars import near_white
    from stratacut.operators.neighborhood import images_of, pixels_of, runs

    images = images_of(pixels)
    white = runs(pixels.where(near_white(tolerance)).select("image_id", F.lit(0).alias("layer_id"), "x", "y"))
    labelled, known = _comps(white, images)
    return pixels_of(labelled.join(known.where("touches_border"), KEY, "left_semi")).drop("layer_id")


def mainland_and_islands(cut: DataFrame, least: int = 0) -> DataFrame:
    """Facts of cut components with role: the largest (first of equals) is the mainland, others of at least ``least`` are islands."""
    first = Window.partitionBy("image_id", "layer_id").orderBy(F.desc("area"), "comp_id")
    return cut.withColumn("_r", F.row_number().over(first)).withColumn("role", F.when(F.col("_r") == 1, "mainland").when(F.col("area") >= least, "island")).where("role is not null").drop("_r")
