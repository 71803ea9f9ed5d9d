"""PNG files as a source and a sink: a Python data source that reads pixels, several files a task, and a writer of one file a picture.

Files are listed and opened through ``pyarrow.fs``, so folders may be local, shared or in an object store that it knows. Files that
can't be decoded are rows with an ``error`` and no pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SCHEMA = "path string, width int, height int, x int, y int, r int, g int, b int, a int, error string"
ARROW = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("width", "height", "x", "y", "r", "g", "b", "a")), ("error", pa.string())])
BLOCK = 1 << 18
ROWS = 1 << 15  # of a batch at least, but for the last one


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Bytes of the rows with their filters undone: none, left, above, mean of both, or the nearest of three (Paeth)."""
    out = np.zeros_like(rows)
    before = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.cumsum(row.reshape(-1, bpp), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            now = row + before
        elif kind in (3, 4):
            up, raw = before.tolist(), row.tolist()
            done = [0] * bpp
            for k, v in enumerate(raw):
                a, b, c = done[k], up[k], up[k - bpp] if k >= bpp else 0
                if kind == 3:
                    guess = a + b >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                done.append(v + guess & 255)
            now = np.array(done[bpp:], np.uint8)
        else:
            raise ValueError(f"row filter {kind}")
        out[y] = before = now
    return out


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes (r, g, b, a) of a PNG: all colour types and depths, checksums verified, interlaced files refused."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, colours, clear, ended = 8, None, [], None, None, False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("file ends early")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or colour not in CHANNELS or not width or not height:
        raise ValueError("interlaced" if interlaced else "bad header")
    n = CHANNELS[colour]
    line = (width * n * depth + 7) // 8
    raw = zlib.decompress(b"".join(packed))
    if len(raw) < height * (line + 1):
        raise ValueError("too few rows")
    rows = np.frombuffer(raw, np.uint8, height * (line + 1)).reshape(height, line + 1)
    flat = _unfiltered(rows[:, 1:], rows[:, 0], max(1, n * depth // 8))
    wide = None
    if depth == 16:
        wide = flat.reshape(height, width, n, 2)
        samples = wide[..., 0]
    elif depth == 8:
        samples = flat.reshape(height, width, n)
    else:
        bits = np.unpackbits(flat, axis=1)[:, : width * depth].reshape(height, width, depth)
        samples = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if colours is None or samples.max() >= len(colours):
            raise ValueError("no colour for an index")
        out[..., :3] = colours[samples[..., 0]]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[samples[..., 0]]
        return out
    scaled = samples * (255 // ((1 << depth) - 1)) if depth < 8 else samples
    out[..., :3] = scaled[..., :3] if n >= 3 else scaled[..., :1]
    if n in (2, 4):
        out[..., 3] = scaled[..., -1]
    elif clear is not None:
        key = np.frombuffer(clear, ">u2")
        own = wide.astype(np.uint16)[..., 0] * 256 + wide[..., 1] if wide is not None else samples
        out[..., 3] = np.where((own == key).all(axis=2), 0, 255)
    return out


class Files(InputPartition):
    """Files of one task."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class PngReader(DataSourceReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        store, base = fs.FileSystem.from_uri(self.folder)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.lower().endswith(".png"))
        # opening a file costs about as much as reading a megabyte, and less where 64 tasks are busy anyhow: a task costs as much as some hundred small files
        cost = min(1 << 20, max(1 << 16, 64 * self.most // max(1, len(found))))
        parts, held, size = [], [], 0
        for path, n in found:
            held.append(path)
            size += n + cost
            if size >= self.most:
                parts.append(Files(held))
                held, size = [], 0
        return [*parts, Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        held, n = [], 0
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    rgba = decode(f.read())
            except (ValueError, OSError, zlib.error, struct.error) as why:
                yield pa.RecordBatch.from_pylist([{"path": path, "error": str(why)}], ARROW)
                continue
            height, width = rgba.shape[:2]
            flat = rgba.reshape(-1, 4)
            for k in range(0, len(flat), BLOCK):
                held.append((path, width, height, k, flat[k : k + BLOCK]))
                n += len(held[-1][-1])
                if n >= ROWS:  # a batch for each small file would cost more than its pixels
                    yield self.rows(held)
                    held, n = [], 0
        if held:
            yield self.rows(held)

    @staticmethod
    def rows(held: list[tuple[str, int, int, int, np.ndarray]]) -> pa.RecordBatch:
        """Rows of parts of pictures: path, width, height, number of the first pixel, and bytes of the pixels."""
        sizes = np.array([len(part) for *_, part in held])
        own = np.repeat(np.arange(len(held)), sizes)
        width, height, first = (np.array([h[k] for h in held], np.int64)[own] for k in (1, 2, 3))
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first
        paths = pa.array([h[0] for h in held]).take(pa.array(own))
        columns = [width, height, at % width, at // width, *np.concatenate([part for *_, part in held]).T]
        return pa.RecordBatch.from_arrays([paths, *(pa.array(c.astype(np.int32)) for c in columns), pa.nulls(len(own), pa.string())], schema=ARROW)


class PngSource(DataSource):
    """``spark.read.format("png_pixels").load(folder)``; option ``partitionBytes``: files of a task, 64 MB by default."""

    @classmethod
    def name(cls) -> str:
        return "png_pixels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PngReader:
        folder = self.options["path"]
        return PngReader(folder if "://" in folder else f"file://{folder}" if not folder.startswith("file:") else "file://" + folder.removeprefix("file:"), int(self.options.get("partitionBytes", 64 << 20)))


def read_pngs(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Rows of SCHEMA of all PNG files below ``folder``."""
    spark.dataSource.register(PngSource)
    return spark.read.format("png_pixels").options(**options).load(folder)


def save_pngs(made: DataFrame, folder: str) -> int:
    """Write (name, png) as files, each first beside its place and then moved there, so that a repeated task changes nothing; how many."""
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, png in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{base}/{name}.part") as f:
                    f.write(png)
                store.move(f"{base}/{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return made.select("name", "png").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
