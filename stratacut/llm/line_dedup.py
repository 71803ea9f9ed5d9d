"""Operator 9: drop lines that many documents share.

Lines are cut at ``\\n``; a line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at both ends and with
A-Z in lower case. Per document each distinct key is emitted once as a 128-bit hash; the hashes are counted over distinct
documents with map-side combining, frequent ones are stored and joined back, and every document's text is put together again
from the lines that stay, in their order. One line may be in a third of all documents: both sides of that join are plain
shuffles, one with a row a key, so adaptive execution splits such a key over as many tasks as its rows need.

Defined results: a null text is an empty text, an empty text is one empty line; keys shorter than ``min_chars`` never go;
repeated rows of one doc_id count as one document and lose the same lines; a row with a null doc_id counts for no line and
keeps all its lines; an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import fresh, read, settle, settled, slices, stored

WHITE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of an already lower-cased line's key; None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(WHITE)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): each distinct key of each document once."""

    @settled
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = {h for line in text.lower().split(b"\n") if len(line) >= min_chars and (h := line_hash(line, min_chars))}
                keys += found
                ids += [doc_id] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(emit, "doc_id long, key binary")


def frequent_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(key, keeper): keys found in at least ``min_docs`` documents and the largest doc_id that holds them."""
    counted = keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n_docs") >= min_docs).select("key", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, and n_lines (before) and n_dropped.

    If ``docs`` has columns of those names, underscores are appended to the new ones.
    """
    keys = line_keys(docs, min_chars)
    frequent = stored(frequent_lines(keys, min_docs))
    drops = keys.join(frequent.hint("merge"), "key").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    @F.arrow_udf("struct<text string, n_lines bigint, n_dropped bigint>")
    def rebuild(texts: pa.Array, goes: pa.Array) -> pa.Array:
        kept, before, dropped = [], [], []
        for at in range(0, len(texts), 500):
            for text, gone in zip(texts.slice(at, 500).cast(pa.binary()).to_pylist(), goes.slice(at, 500).to_pylist(), strict=True):
                if gone:
                    lines, out = (text or b"").split(b"\n"), set(gone)
                    stay = [x for x in lines if line_hash(x.lower(), min_chars) not in out]
                    kept.append(b"\n".join(stay))
                    before.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                else:
                    kept.append(text or b"")
                    before.append(1 + kept[-1].count(b"\n"))
                    dropped.append(0)
        settle()
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    gone, made, of = (fresh(c, docs.columns) for c in ("_gone", "_made", "_of"))
    n_lines, n_dropped = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
    joined = docs.join(drops.select(F.col("doc_id").alias(of), F.col("keys").alias(gone)), F.col("doc_id") == F.col(of), "left").drop(of)
    return joined.withColumn(made, rebuild("text", gone)).select(
        *[F.col(f"{made}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.col(f"{made}.n_lines").alias(n_lines), F.col(f"{made}.n_dropped").alias(n_dropped),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents),
lines as (select doc_id, unnest(lines) line, unnest(range(len(lines))) pos from docs),
keyed as (select doc_id, line, pos,
  translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
frequent as (select k, max(doc_id) keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select y.*, f.k is not null and y.doc_id <> f.keeper gone from keyed y left join frequent f on y.k = f.k)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256
from marked group by doc_id
"""

QUERIES = {"op9_line_dedup": query}
ORACLES = {"op9_line_dedup": SQL}
