"""Operator 7: find and cut passages of benchmarks, by an FM-index over every shard of the training documents.

A task takes its documents in shards of about ``SHARD`` words. Words of a shard become numbers of the benchmark's vocabulary
(0: any other word, or the gap between documents); stretches too short to hold any window are left out, as nothing can occur
there. The suffix array of what is left comes from prefix doubling, its Burrows-Wheeler transform is kept as a wavelet matrix,
and all windows are searched backwards at once by wavelet ranks. Occurrences are located by walking back to a sampled suffix
position; their word spans are merged per document.

The benchmark's distinct windows are given to the tasks in blocks of at most about ``BLOCK`` windows, one after another, so
what is broadcast at a time is bounded however large the benchmark is. Documents are never shuffled.

Defined results: a null text has no words; an item without words has no windows; repeated rows are each searched; an empty
benchmark or table gives no hits or no rows; further columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import fresh, read, settle, settled, slices, stored

SHARD = 500_000
BLOCK = 200_000
SAMPLE = 8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the contract's class, over UTF-8 bytes in lower case


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative numbers by prefix doubling; after the first round only ties are sorted again."""
    n = len(s)
    bits = max(1, int(s.max(initial=0)).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate([s.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | padded[k : n + k]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.append(True, key[sa][1:] != key[sa][:-1])
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        first = np.append(rank[sa][1:] != rank[sa][:-1], True)
        tied = ~(first & np.append(True, first[:-1]))
        where = np.flatnonzero(tied)
        if not len(where):
            return sa
        own = sa[where]
        after = own + depth
        # a suffix that ends within ``depth`` counts by how much is left, before all others
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + depth + 1, n - own)
        order = np.lexsort((follow, rank[own]))
        own, follow = own[order], follow[order]
        group = rank[own]
        sa[where] = own
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        rank[own] = where[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        depth *= 2


class FMIndex:
    """FM-index of a sequence of numbers; 0 separates and is never searched."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.levels = max(1, int(s.max(initial=0)).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << self.levels))])
        self.zeros, self.split = [], []
        current = bwt
        for level in range(self.levels - 1, -1, -1):
            zero = (current >> level & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            current = np.concatenate([current[zero], current[~zero]])
        self.bwt = bwt
        keep = (sa % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])
        self.samples = sa[keep]

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before ``at`` that ``symbol`` precedes, counted from the symbol's first row on (the LF step)."""
        start = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = symbol >> level & 1 == 1
            za, zs = self.zeros[k][at], self.zeros[k][start]
            at = np.where(one, self.split[k] + at - za, za)
            start = np.where(one, self.split[k] + start - zs, zs)
        return self.first[symbol] + at - start

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns at once: those that occur, and the rows [from, to) of each."""
        there = np.zeros(max(int(patterns.max(initial=0)) + 1, len(self.first)), bool)
        there[: len(self.first) - 1] = np.diff(self.first) > 0
        there[0] = True  # fills shorter patterns up
        live = np.flatnonzero(there[patterns].all(1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(patterns.shape[1]):
            go = lengths[live] > j
            symbol = patterns[live, np.maximum(lengths[live] - 1 - j, 0)]
            a, b = self.back(symbol, low), self.back(symbol, high)
            low, high = np.where(go, a, low), np.where(go, b, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to sampled ones."""
        out = np.empty(len(rows), np.int64)
        open_, walked = np.arange(len(rows)), 0
        while len(open_):
            sampled = self.kept[rows + 1] > self.kept[rows]
            out[open_[sampled]] = self.samples[self.kept[rows[sampled]]] + walked
            open_, rows = open_[~sampled], rows[~sampled]
            rows = self.back(self.bwt[rows], rows)
            walked += 1
        return out


class Windows:
    """A block of the benchmark: distinct windows as numbers of its vocabulary, and the items that have each."""

    def __init__(self, found: dict[tuple[bytes, ...], list[int]]):
        vocabulary = sorted({w for window in found for w in window})
        self.number = {w: k for k, w in enumerate(vocabulary, 1)}
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), int(self.lengths.max(initial=1))), np.int64)
        for k, window in enumerate(found):
            self.patterns[k, : len(window)] = [self.number[w] for w in window]
        self.items = [sorted(set(x)) for x in found.values()]
        self.shortest = int(self.lengths.min(initial=1 << 30))

    @staticmethod
    def of(items: list[tuple[int, bytes | None]], size: int) -> Windows:
        found: dict[tuple[bytes, ...], list[int]] = {}
        for item, text in items:
            ws = words(text)
            for k in range(max(1, len(ws) - size + 1) if ws else 0):
                found.setdefault(tuple(ws[k : k + size]), []).append(item)
        return Windows(found)


def search(docs: list[list[bytes]], block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of a block's windows in a shard: document, first word there, window."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(block.lengths):
        return none
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    get = block.number.get
    for at, ws in zip(starts.tolist(), docs, strict=True):
        numbers[at : at + len(ws)] = list(map(get, ws, repeat(0)))
    # stretches of known words that a window fits in, each with one gap after it
    known = np.concatenate([[False], numbers > 0, [False]])
    a, b = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
    fits = b - a >= block.shortest
    if not fits.any():
        return none
    inside = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(inside, a[fits], 1)
    np.add.at(inside, b[fits] + 1, -1)
    origin = np.flatnonzero(np.cumsum(inside)[:-1])
    index = FMIndex(numbers[origin])
    which, low, high = index.count(block.patterns, block.lengths)
    many = high - low
    window = np.repeat(which, many)
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    at = origin[index.locate(rows)]
    doc = np.searchsorted(starts, at, "right") - 1
    return doc, at - starts[doc], window


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(sizes: list[int], doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> list[list[tuple[int, int]]]:
    """Merged word spans of each document of a shard."""
    starts = np.cumsum(np.array(sizes, np.int64) + 1) - np.array(sizes, np.int64) - 1
    total = int(starts[-1] + sizes[-1] + 1) if sizes else 0
    change = np.bincount(starts[doc] + at, minlength=total + 1) - np.bincount(starts[doc] + at + length, minlength=total + 1)
    hit = np.concatenate([[False], np.cumsum(change) > 0])
    a, b = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for k, x, y in zip((np.searchsorted(starts, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
        out[k].append((x - int(starts[k]), y - int(starts[k])))
    return out


FOUND = "array<struct<first:int,end:int>>"


def blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """The items with words, in blocks of at most about ``BLOCK`` windows (a single item may be longer)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    parts = max(1, -(-total // (4 * BLOCK)))  # a word with what parts it is seldom under four bytes
    for k in range(parts):
        yield [(r["item_id"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with n_words, spans (merged word spans, end exclusive) and items (ids as strings) of benchmark windows.

    If ``docs`` has columns of those names, underscores are appended to the new ones (their order is the one given here).
    """
    spark = docs.sparkSession
    n_words, spans, items = (fresh(c, docs.columns) for c in ("n_words", "spans", "items"))
    text = fresh("_bytes", docs.columns)
    out = docs.withColumn(n_words, F.lit(0).cast("long")).withColumn(spans, F.lit(None).cast(FOUND)).withColumn(items, F.lit(None).cast("array<string>"))
    given = None
    for own in blocks(benchmark, size):
        if given is not None:  # what the block before has found is a table, and its index is given back
            out = stored(out)
            given.unpersist()
        given = spark.sparkContext.broadcast(own)

        @settled
        def look(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            block = Windows.of(given.value, size)
            for batch in slices(batches, 4000):
                names = batch.schema.names
                texts = batch.column(names.index(text)).to_pylist()
                counts: list[int] = []
                new_spans: list[list[tuple[int, int]]] = []
                new_items: list[list[str]] = []
                shard: list[list[bytes]] = []

                def flush(shard=shard, new_spans=new_spans, new_items=new_items) -> None:
                    doc, at, window = search(shard, block)
                    new_spans += spans_of([len(d) for d in shard], doc, at, block.lengths[window])
                    found: list[set[str]] = [set() for _ in shard]
                    for pair in np.unique(doc * len(block.lengths) + window).tolist() if len(doc) else ():
                        d, w = divmod(pair, len(block.lengths))
                        found[d].update(block.items[w])
                    new_items.extend(map(sorted, found))
                    shard.clear()

                held = 0
                for t in texts:
                    shard.append(ws := words(t))
                    counts.append(len(ws))
                    held += len(ws)
                    if held >= SHARD:
                        flush()
                        held = 0
                if shard:
                    flush()
                old_spans, old_items = (batch.column(names.index(c)).to_pylist() for c in (spans, items))
                all_spans = [merged(b + [(x["first"], x["end"]) for x in a]) if a else b for a, b in zip(old_spans, new_spans, strict=True)]
                all_items = [sorted({*a, *b}) if a else b for a, b in zip(old_items, new_items, strict=True)]
                made = {
                    n_words: pa.array(counts, pa.int64()),
                    spans: pa.array([[{"first": x, "end": y} for x, y in s] for s in all_spans], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                    items: pa.array(all_items, pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([made.get(c, batch.column(k)) for k, c in enumerate(names)], names)

        seen = out.withColumn(text, F.col("text").cast("binary"))
        out = seen.mapInArrow(look, seen.schema).drop(text)
    return out


def cut(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with every hit word span taken out of ``text``, from the span's first word to its last."""
    found = leaks(docs, benchmark, size)
    spans = found.columns[-2]

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in ((t, s) for at in range(0, len(texts), 1000) for t, s in zip(texts.slice(at, 1000).cast(pa.binary()).to_pylist(), spans.slice(at, 1000).to_pylist(), strict=True)):
            if own:
                at = [m.span() for m in WORD.finditer(text.lower())]
                parts, begin = [], 0
                for s in own:
                    parts.append(text[begin : at[s["first"]][0]])
                    begin = at[s["end"] - 1][1]
                text = b"".join([*parts, text[begin:]])
            out.append(text)
        settle()
        return pa.array(out, pa.binary()).cast(pa.string())

    return found.select(*[without("text", F.col(spans)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') k
       from (select item_id, w, least(len(w), 10) n, unnest(range(len(w) - least(len(w), 10) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') k
       from (select doc_id, w, n, unnest(range(len(w) - n + 1)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, dw.n, i from dw join bw using (n, k)),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) s
          from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

QUERIES = {"op7_benchmark_decontamination": query}
ORACLES = {"op7_benchmark_decontamination": SQL}
