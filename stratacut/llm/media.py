"""Operator 8: media columns. Payloads become FLAC streams in a binary column and come back as seekable PCM blocks.

``to_flac`` codes a binary column; ``pcm_blocks`` decodes Rice residuals and linear predictors, verifies the checksum of every
frame and returns one row per block of samples with the number of its first sample; ``probe`` cuts the same blocks, gives their
places and checksums as a table to seek by, and features of what was read back from them. All are maps over rows: nothing is
shuffled, and a task holds one group of at most ``GROUP`` bytes and one row more. The streams aren't written to the shared folder
on the way from one to the other: coded text is hardly smaller than text, 1.7 times its compressed table.

Defined results: a null or empty text is stored as 192 blanks; equal texts, repeated rows too, give equal streams and values; a
stream that is damaged, cut short or null gives a row with ``error`` and no samples; rows with a null doc_id are coded as any; an
empty table gives an empty result; only the columns named come out, whatever further columns the documents have.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm import flac
from stratacut.llm.common import read, settled

GROUP = 1 << 21
BLOCK = 48_000  # samples of a PCM block


def payload(text: bytes | None) -> bytes:
    """Bytes of the text, then blanks up to a positive multiple of 192."""
    data = text or b""
    return data + b" " * (-len(data) % flac.BLOCK or (0 if data else flac.BLOCK))


def groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[bytes | None]]]:
    """Rows of each batch, some at a time: the first column's values and the bytes of ``column``."""
    for batch in batches:
        ids, data = batch.column(0).to_pylist(), batch.column(column).cast(pa.binary())
        sizes = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in data])
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP)))
            yield ids[at:end], data.slice(at, end - at).to_pylist()
            at = end


def to_flac(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a FLAC stream."""

    @settled
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups(batches, 1):
            media = flac.encode([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, "doc_id long, n_bytes long, media binary")


def blocks_of(samples: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """The first sample's number and the samples of each block."""
    return ((at, samples[at : at + block].astype("<i2")) for at in range(0, len(samples), block))


def pcm_blocks(media: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, block, first_sample, n_samples, pcm, error): 16-bit little-endian samples of (doc_id, media), seekable by first_sample.

    The samples of several channels are interleaved; samples of more than 16 bits are an error.
    """

    @settled
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, streams in groups(batches, 1):
            rows = []
            for doc_id, got in zip(ids, flac.decode_all([s or b"" for s in streams]), strict=True):
                if isinstance(got, flac.Damaged) or len(got) and np.abs(got).max() > 32768:
                    rows.append((doc_id, 0, 0, 0, None, str(got) if isinstance(got, flac.Damaged) else "over 16 bits"))
                else:
                    rows += [(doc_id, at // block, at, len(x), x.tobytes(), None) for at, x in blocks_of(got, block)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "block", "first_sample", "n_samples", "pcm", "error"])

    return media.select("doc_id", "media").mapInArrow(decode, "doc_id long, block int, first_sample long, n_samples long, pcm binary, error string")


def features(samples: np.ndarray) -> str:
    """Peak, mean, root mean square and sign changes of 8-bit samples, in whole numbers."""
    x = samples.astype(np.int64)
    n = max(1, len(x))
    return f"peak={int(np.abs(x).max(initial=0))};mean={int(x.sum()) * 1000 // n};ms={int((x * x).sum()) * 1000 // n};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def probe(media: DataFrame, block: int = BLOCK) -> DataFrame:
    """What is read back from (doc_id, n_bytes, media): sizes, checksums and features of payload and stored form, and its PCM blocks' places."""

    @settled
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            at = 0
            for ids, streams in groups(iter([batch]), 2):
                rows = []
                for doc_id, stream, got in zip(ids, streams, flac.decode_all([s or b"" for s in streams]), strict=True):
                    if isinstance(got, flac.Damaged):
                        rows.append((doc_id, sizes[at], None, None, None, len(stream or b""), hashlib.sha256(stream or b"").hexdigest(), f"error={got}", []))
                    else:
                        cut = list(blocks_of(got, block))
                        read_back = np.concatenate([x for _, x in cut])
                        data = (read_back + 128).astype(np.uint8).tobytes()
                        seek = [{"first_sample": first, "n_samples": len(x), "crc32": zlib.crc32(x.tobytes())} for first, x in cut]
                        rows.append((doc_id, sizes[at], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), features(read_back), seek))
                    at += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), SEEK)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], PROBED)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(look, PROBE)


SEEK = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("crc32", pa.int64())]))
PROBED = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks"]
PROBE = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "pcm_blocks array<struct<first_sample:bigint,n_samples:bigint,crc32:bigint>>"
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe(to_flac(read(spark, sf_dir, "documents")))


QUERIES = {"op8_flac_media": query}
ORACLES: dict[str, str] = {}
