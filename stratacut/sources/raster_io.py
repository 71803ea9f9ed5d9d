"""Pictures in and out: image files, data URLs, pixel tables, PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.functions.scalars import luma, rounded
from stratacut.operators import batches
from stratacut.operators.neighborhood import images_of

PIXELS = "image_id long, x int, y int, r int, g int, b int, a int"


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, path, image) of the picture files below ``folder``; what can't be decoded is left out. image_id is a hash of the path."""
    found = spark.read.format("image").option("dropInvalid", True).load(folder)
    kept = found.where(F.lower("image.origin").rlike(r"\.(png|jpe?g|gif|bmp)$"))
    return kept.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("path"), "image")


def pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel of (image_id, image), with luma; rows of one picture at a time, row 0 on top."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, w, h, n, data in batch.itertuples(index=False, name=None):
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                for top in range(0, h, max(1, (1 << 18) // w)):
                    part = raw[top : top + max(1, (1 << 18) // w)].reshape(-1, n).astype(np.int32)
                    c = part[:, [0, 0, 0]] if n == 1 else part[:, [2, 1, 0]]  # stored as BGR(A)
                    k = np.arange(len(part))
                    yield pd.DataFrame({"image_id": i, "x": (k % w).astype(np.int32), "y": (top + k // w).astype(np.int32), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2], "a": part[:, 3] if n == 4 else np.int32(255)})

    flat = images.select("image_id", "image.width", "image.height", "image.nChannels", "image.data")
    return flat.mapInPandas(explode, PIXELS).withColumn("luma", luma())


def decode_url(url: Column) -> Column:
    """struct<mime, bytes> of a base64 data URL."""
    return F.struct(F.regexp_extract(url, "^data:([^;,]*)", 1).alias("mime"), F.unbase64(F.element_at(F.split(url, ",", 2), 2)).alias("bytes"))


def is_picture(mime: Column) -> Column:
    return mime.startswith("image/")


def encode_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64(png), "\r\n", ""))


def shrink(dense: DataFrame, most: int = 4096) -> DataFrame:
    """Pictures with a longest side over ``most`` scaled to it by the mean of the pixels that fall together; others as they are."""
    sized = dense.join(images_of(dense), "image_id").withColumn("_s", F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("width", "height")))
    w, h = rounded(F.col("width") * F.col("_s")), rounded(F.col("height") * F.col("_s"))
    at = lambda c, to, size: F.floor(F.col(c) * to / F.col(size)).cast("int").alias(c)
    moved = sized.select("image_id", at("x", w, "width"), at("y", h, "height"), "r", "g", "b", "a")
    return moved.groupBy("image_id", "x", "y").agg(*(rounded(F.avg(c)).cast("int").alias(c) for c in "rgba"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _deflated(canvas: np.ndarray) -> tuple[bytes, int, int]:
    """Rows of a picture as a part of a deflate stream that refers to no other part, with the rows' Adler-32 and their number of bytes."""
    raw, coder = canvas.tobytes(), zlib.compressobj(wbits=-15)
    return coder.compress(raw) + coder.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def adler_of_both(first: int, second: int, size: int) -> int:
    """Adler-32 of two byte strings one after the other, from theirs and the second's size."""
    low = ((first & 0xFFFF) + (second & 0xFFFF) - 1) % 65521
    high = ((first >> 16) + (second >> 16) + size * ((first & 0xFFFF) - 1)) % 65521
    return high << 16 | low


def to_png(coloured: DataFrame, images: DataFrame, part: int = 1 << 18) -> DataFrame:
    """(image_id, layer_id, png) of (image_id, layer_id, x, y, r, g, b, a); pixels that aren't there are transparent.

    Rows of about ``part`` pixels are coded by themselves, so no task holds a whole picture's pixels; a last step puts the coded
    parts of a picture, each a chunk of its file, in order.
    """
    key = ["image_id", "layer_id"]

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        first = batches.starts(rows, [*key, "_part"])
        heads = rows.iloc[first]
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        rgba, coded = rows[list("rgba")].to_numpy(np.uint8), []
        sizes = heads[["width", "height", "_per", "_part"]].to_numpy().tolist()
        for a, b, (width, height, per, k) in zip(first, [*first[1:], len(rows)], sizes, strict=True):
            canvas = np.zeros((min(per, height - k * per), 1 + 4 * width), np.uint8)
            for i in range(4):
                canvas[y[a:b] - k * per, 1 + 4 * x[a:b] + i] = rgba[a:b, i]
            coded.append(_deflated(canvas)[:2])
        return heads[[*key, "width", "height", "_per", "_part"]].assign(data=[d for d, _ in coded], adler=[v for _, v in coded])

    def file(parts: list[tuple]) -> bytes:
        width, height, per = parts[0][:3]
        there, adler, chunks = {k: (data, own) for *_, k, data, own in parts}, 1, []
        n = -(-height // per)
        for k in range(n):
            rows = min(per, height - k * per)
            size = rows * (1 + 4 * width)
            data, own = there[k] if k in there else _deflated(np.zeros((rows, 1 + 4 * width), np.uint8))[:2]
            adler = adler_of_both(adler, own, size)
            chunks.append(_chunk(b"IDAT", (b"\x78\x9c" if k == 0 else b"") + data + (zlib.compressobj(wbits=-15).flush() + struct.pack(">I", adler) if k == n - 1 else b"")))
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + b"".join(chunks) + _chunk(b"IEND", b"")

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        first = batches.starts(parts, key)
        rows = list(zip(*(parts[c].tolist() for c in ("width", "height", "_per", "_part", "data", "adler")), strict=True))
        made = [file(rows[a:b]) for a, b in zip(first, [*first[1:], len(parts)], strict=True)]
        return parts.iloc[first][key].assign(png=made)

    per = F.greatest(F.lit(1), F.floor(F.lit(part) / F.col("width"))).cast("int")
    placed = coloured.join(images, "image_id").withColumn("_per", per).withColumn("_part", F.floor(F.col("y") / F.col("_per")).cast("int"))
    coded = batches.by_groups(placed, [*key, "_part"], [], code, "image_id long, layer_id int, width int, height int, _per int, _part int, data binary, adler long")
    return batches.by_groups(coded, key, ["_part"], join, "image_id long, layer_id int, png binary", 64)


def enlarged(coloured: DataFrame, images: DataFrame, scale: int = 4) -> DataFrame:
    """Every pixel as scale x scale equal ones, on a white ground; (image_id, layer_id, x, y, r, g, b, a)."""
    layers = coloured.select("image_id", "layer_id").distinct().join(images, "image_id")
    every = layers.select("image_id", "layer_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "height").select("image_id", "layer_id", "x", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    white = lambda c: F.coalesce(F.when(F.col("a") > 0, F.col(c)), F.lit(255)).alias(c)
    flat = every.join(coloured, ["image_id", "layer_id", "x", "y"], "left").select("image_id", "layer_id", "x", "y", *map(white, "rgb"), F.lit(255).alias("a"))
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    return flat.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select("image_id", "layer_id", (F.col("x") * scale + F.col("_i")).alias("x"), (F.col("y") * scale + F.col("_j")).alias("y"), "r", "g", "b", "a")


def save_layers(layers: DataFrame, path: str) -> None:
    """Write layers, a folder each; only the layers that ``layers`` has are replaced, others stay as they are."""
    layers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer_id").parquet(path)


def stored_layers(spark: SparkSession, path: str, *layer_ids: int) -> DataFrame:
    """Saved layers; with ids, only their folders are read."""
    every = spark.read.parquet(path)
    return every.where(F.col("layer_id").isin(*layer_ids)) if layer_ids else every
