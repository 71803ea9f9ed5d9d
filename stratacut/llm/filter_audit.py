"""Operator 13: what each filter removes, repeats and loses, in every order in which five filters may run.

Every document gets a mask of the filters it fails (A few words, B repeated words, C capitals, D symbols, E copy of an earlier
document). Documents with equal masks and labels behave alike in every order, so they are counted first, by part. A part's audit
is then a product over the (min, +) semiring: the mask matrix (0 where a filter fails, infinity where it passes) times the
matrix of each order's inverse permutation (the step at which a filter runs). Its entry is the step that removes the documents of
that mask; weighted scatter counts over those steps give all columns.

Copies: texts are keyed by a 128-bit hash, counted by key, part, mask and labels with map-side combining, each count with its
smallest doc_id. All rows of a key but those of the smallest doc_id of all fail E, so no row is joined back to its group and a
group that holds a third of all rows is a handful of counts.

Defined results: a null text is an empty text (it fails A); a null lang is the part ``''``; repeated rows of one doc_id each
count, and don't make one another fail E (no id is smaller); rows with a null doc_id are never copies and make none, and have no
labels; labels repeated for one doc_id count as 1 if one of them is 1; an empty table has no parts and gives an empty result;
further columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacut.llm.common import read, settled, slices

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
UPPER = bytes(range(0x41, 0x5B))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOL = re.compile(rb"[#$%&*|]")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_failures(text: bytes, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> int:
    """The mask of A to D: bit 0 is A."""
    words = text.split()  # bytes: at [\x20\x09-\x0D]
    points = len(text) if text.isascii() else len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, UPPER))
    few, repeated = len(words) < min_words, 100 * len(set(words)) < distinct_percent * len(words)
    return few | repeated << 1 | (100 * capitals > capital_percent * points) << 2 | (SYMBOL.search(text) is not None) << 3


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, key, mask) of every row: its hash and which of A to D it fails."""

    @settled
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            keys = [xxhash.xxh3_128_digest(t) for t in texts]
            found = [own_failures(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(found, pa.int32())], ["doc_id", "part", "key", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(emit, "doc_id long, part string, key binary, mask int")


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows of a part that fail the filters of a mask, by label; bit 4 of the mask is E."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = masks(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    alike = ["key", "part", "mask", "good", "toxic"]
    rows = labelled.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))  # dealt by doc_id already
    groups = rows.groupBy(*alike, F.col("doc_id").isNull().alias("unknown")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("key"))  # a row a part, mask and label
    own = F.when(F.col("unknown"), F.col("n")).when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    split = groups.withColumn("smallest", smallest).withColumn("own", own).select("part", "good", "toxic", F.explode(both).alias("of"))
    return split.where("of.n > 0").groupBy("part", F.col("of.mask").alias("mask"), "good", "toxic").agg(F.sum("of.n").alias("n"))


def removal_steps(fails: np.ndarray, orders: list[str] = ORDERS) -> np.ndarray:
    """(masks x orders): the step, from 0, that removes documents which fail ``fails`` (masks x filters); the number of filters if none does.

    The (min, +) product of the mask matrix and the orders' inverse permutations.
    """
    n = fails.shape[1]
    order = np.array([[FILTERS.index(c) for c in o] for o in orders])
    position = np.argsort(order, axis=1)  # inverse permutation: the step of each filter
    weight = np.where(fails, 0.0, np.inf)
    return np.minimum((weight[:, None, :] + position[None, :, :]).min(axis=2), n).astype(np.int64)


def audited(part: str, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """The audit of one part from its counts: a row for each order and step."""
    width = len(FILTERS)
    fails = (mask[:, None] >> np.arange(width) & 1).astype(bool)
    steps = removal_steps(fails)
    order = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    at = np.arange(len(ORDERS))

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ORDERS), width + 1), np.int64)
        np.add.at(out, (np.broadcast_to(at, steps.shape), steps), np.broadcast_to(weight[:, None], steps.shape))
        return out[:, :width]

    removed = scattered(n)
    failing, alone = fails.T.astype(np.int64) @ n, (fails & (fails.sum(axis=1, keepdims=True) == 1)).T.astype(np.int64) @ n
    shapley = np.zeros(width, np.int64)
    np.add.at(shapley, order, removed)
    columns = [n.sum() - removed.cumsum(axis=1), removed, failing[order] - removed, alone[order], scattered(n * good), scattered(n * toxic), shapley[order]]
    out = {"part": part, "filter_order": np.repeat(ORDERS, width), "step": np.tile(np.arange(1, width + 1, dtype=np.int32), len(ORDERS))}
    return pd.DataFrame(out | {c: x.ravel() for c, x in zip(COUNTS, columns, strict=True)})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order and step; a part's group has at most 32 masks by four labels."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return audited(pdf["part"].iloc[0], *(pdf[c].to_numpy(np.int64) for c in ("mask", "good", "toxic", "n")))

    return counted(docs, labels).groupBy("part").applyInPandas(whole, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
with docs as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
worded as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, min(doc_id) over (partition by t) smallest from docs),
failing as (select part, doc_id, len(w) < 100 a, 100 * len(list_distinct(w)) < 80 * len(w) b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) c, regexp_matches(t, '[#$%&*|]') d, doc_id > smallest e from worded),
marks as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
counted as (select part, a, b, c, d, e, coalesce(good, 0) good, coalesce(toxic, 0) toxic, count(*) n
  from failing left join marks using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (select p.l || q.l || r.l || s.l || t.l o from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
stepped as (select *, least(case when a then strpos(o, 'A') else 9 end, case when b then strpos(o, 'B') else 9 end, case when c then strpos(o, 'C') else 9 end,
    case when d then strpos(o, 'D') else 9 end, case when e then strpos(o, 'E') else 9 end) gone, a::int + b::int + c::int + d::int + e::int n_fails
  from counted, orders),
steps as (select *, substr(o, step::int, 1) f from orders, (select unnest(range(1, 6)) step)),
judged as (select x.*, step, f, case f when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end bad
  from stepped x join steps using (o)),
rows_ as (select part, o, step, f, sum(case when gone > step then n else 0 end) kept, sum(case when gone = step then n else 0 end) removed,
  sum(case when bad and gone < step then n else 0 end) redundant, sum(case when bad and n_fails = 1 then n else 0 end) unique_fails,
  sum(case when gone = step then n * good else 0 end) good_lost, sum(case when gone = step then n * toxic else 0 end) toxic_lost
  from judged group by part, o, step, f)
select part, o filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley
from rows_
"""

QUERIES = {"op13_filter_interaction_audit": query}
ORACLES = {"op13_filter_interaction_audit": SQL}
