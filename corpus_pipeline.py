"""The corpus pipeline: documents through quality, line dedup, near dedup, decontamination and packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last one
returns packed pieces. Where a stage changes texts, ``n_chars`` follows (null for a null text). Null and empty texts pass: the
quality stage judges them as any text, no later stage drops a document for being empty.

Repeated rows of one doc_id go through quality, lines and decontamination each by itself and are one document from near dedup on;
rows with a null doc_id are never duplicates of anything and stay. An empty table gives an empty result. Further columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm import decontaminate, line_dedup, near_dedup, packing, quality
from stratacut.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, and n_chars of the texts as they are now."""
    return changed.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, learnt from the labels, doesn't reject."""
    scored = quality.quality(docs, read(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in the last of them only."""
    return like(docs, line_dedup.dedup_lines(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near-duplicates."""
    return near_dedup.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return like(docs, decontaminate.cut(docs, read(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("MinHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]

#: The first stage is a learnt network and the third samples: SQL can't express them. Tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
