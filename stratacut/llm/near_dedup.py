"""Operator 5: near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are ``WIDTH`` words (runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case); a text of fewer
words is one shingle. A shingle weighs tf * idf, idf = 1 + ln(1 / max(p, ``RARE``)), p being the share of the documents that have
it: the weight depends on shares alone, not on how large the corpus is, and is flat for what fewer than one document in 32 has,
so the edits of a copy don't outweigh all that it shares. Frequencies of the others are exact: a mergeable Misra-Gries summary
proposes them (at most mean length / ``RARE`` can be that frequent, whatever the number of documents; the number of counters is
doubled until it proves that none is missed) and a second pass counts them.

Documents of equal words form one node. Nodes are sampled ``BANDS * ROWS`` times in proportion to their weights, equal bands
make buckets, and links are verified by weighted Jaccard similarity of the whole texts. A bucket is never paired out. First all
of its members are compared with the one that meets most others in all buckets (the origin, in a group of copies). Where a
bucket still holds several classes, its members are completed by an exact index on the rarest shared shingles (``crossing``),
which proposes every pair of different classes that can be similar, and hardly any other. Classes come from large-star/small-star
rounds over tables in the shared folder.

Defined results: documents without words (null, empty, punctuation) are alone; a row with a null doc_id has a null class and no
links; repeated rows get the class of their text; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacut.llm.common import fresh, read, settle, settled, slices, stored
from stratacut.llm.hashing import BASE, U, mixed, word_bounds
from stratacut.llm.hashing import word_hashes as hashes_of

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 6
COUNTERS = 1 << 17
RARE = 1 / 32
SLACK = 1 - 1e-9  # sums of weights differ by how they are added up

_rng = np.random.default_rng(21)
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MIX = [U(x | 1) for x in _rng.integers(1 << 40, 1 << 63, WIDTH).tolist()]
#: One draw of (r, c, beta) for each of 2^16 values; which one a shingle takes in a sample is a hash of both.
R, C, B = _rng.gamma(2, 1, 1 << 16), _rng.gamma(2, 1, 1 << 16), _rng.random(1 << 16)
SEEDS = _rng.integers(1 << 40, 1 << 63, BANDS * ROWS, dtype=np.uint64) | U(1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    b = LOWER[np.frombuffer(text, np.uint8)]
    return hashes_of(b, *word_bounds(b, IS_WORD))


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, how often each occurs, and the words' hashes."""
    words = word_hashes(text or b"")
    if not len(words):
        return words, np.zeros(0, np.int64), words
    n = max(1, len(words) - WIDTH + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(words))):
        total += words[k : k + n] * MIX[k]
    h = np.sort(mixed(total))
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.diff(np.append(first, len(h))), words


class Weights:
    """Inverse document frequencies: those of frequent shingles, and one for all others."""

    def __init__(self, rows: list[tuple[int, int]], n_docs: int):
        self.keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.values = 1 - np.log(np.maximum(np.array([r[1] for r in rows], float) / max(n_docs, 1), RARE))[order]
        self.rest = 1 - float(np.log(RARE))

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.full(len(h), self.rest)
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            w = np.where(self.keys[at] == h, self.values[at], w)
        return w * tf


@lru_cache(maxsize=2)
def _usual(w: float) -> np.ndarray:
    """What each draw gives a shingle of weight ``w``."""
    t = np.floor(np.log(w) / R + B)
    return C / np.exp(R * (t - B) + R)


def signature(h: np.ndarray, w: np.ndarray, rest: float) -> np.ndarray:
    """Consistent weighted samples, each as a hash of (shingle, t)."""
    odd = np.flatnonzero(w != rest)
    usual, out = _usual(rest), np.empty(len(SEEDS), np.uint64)
    log_w, log_rest = np.log(w[odd]), np.log(rest)
    step = max(1, 200_000 // max(1, len(h)))
    for a in range(0, len(SEEDS), step):
        seeds = SEEDS[a : a + step]
        draw = ((h[None, :] * seeds[:, None]) >> U(48)).astype(np.int64)
        value = usual[draw]
        if len(odd):
            r, c, b = (x[draw[:, odd]] for x in (R, C, B))
            value[:, odd] = c / np.exp(r * (np.floor(log_w / r + b) - b) + r)
        best = value.argmin(1)
        own = draw[np.arange(len(seeds)), best]
        log_best = np.full(len(h), log_rest)
        log_best[odd] = log_w
        t = np.floor(log_best[best] / R[own] + B[own]).astype(np.int64)
        out[a : a + step] = mixed(h[best] * U(3) + seeds + t.view(np.uint64) * BASE)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    parts = sample.reshape(BANDS, ROWS) * SEEDS[:ROWS]
    return mixed(parts.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * BASE)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null and text is not null")


def _heaviest(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: sum equal keys; if over ``most`` are left, take the next one's count off all."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def likely(texts: DataFrame, counters: int) -> tuple[DataFrame, int, int]:
    """(key, n) of a Misra-Gries summary of the shingles, the number of documents and of their distinct shingles in all."""

    @settled
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, n_docs, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0
        pending = 0
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                held.append(shingles(text)[0])
                n_docs, pending = n_docs + 1, pending + len(held[-1])
                total += len(held[-1])
                if pending > 1 << 20:
                    own = np.concatenate(held)
                    keys, counts = _heaviest(np.concatenate([keys, own]), np.concatenate([counts, np.ones(len(own), np.int64)]), counters)
                    held, pending = [], 0
        own = np.concatenate([*held, np.zeros(0, np.uint64)])
        keys, counts = _heaviest(np.concatenate([keys, own]), np.concatenate([counts, np.ones(len(own), np.int64)]), counters)
        some = counts > RARE / 2 * n_docs  # a key that few of a task's documents have may go: that takes no more than RARE / 2 of all documents off
        keys, counts = keys[some], counts[some]
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys.view(np.int64), [0, 0])), pa.array(np.append(counts, [n_docs, total])), pa.array([0] * n + [1, 2], pa.int32())], ["key", "n", "kind"])

    summed = stored(texts.mapInArrow(summarise, "key long, n long, kind int").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in summed.where("kind > 0").collect()}
    return summed.where("kind = 0"), totals.get(1, 0), totals.get(2, 0)


def weights(texts: DataFrame, counters: int = COUNTERS) -> Weights:
    """Exact document frequencies of all shingles that more than ``RARE`` of the documents have."""
    summed, n_docs, total = likely(texts, counters)
    while 4 * total >= RARE * n_docs * (counters + 1) and total:  # counts are short by total / (counters + 1) at most, and by RARE / 2 * n_docs
        counters *= 2
        summed, n_docs, total = likely(texts, counters)
    # a key that is frequent enough has at least this much left in the summary: at most 4 * mean length / RARE rows
    some = summed.where(F.col("n") > F.lit(RARE / 2 * n_docs - total / (counters + 1))).select("key").collect()
    given = texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r["key"] for r in some], np.int64).view(np.uint64)))

    @settled
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = given.value
        n = np.zeros(len(keys), np.int64)
        for batch in slices(batches):
            for text in batch.column(1).to_pylist() if len(keys) else ():
                h = shingles(text)[0]
                if len(h):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    n[at[keys[at] == h]] += 1
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys[found].view(np.int64)), pa.array(n[found])], ["key", "n"])

    counted = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(RARE * n_docs))
    rows = [(r["key"], r["n"]) for r in counted.collect()]  # at most mean length / RARE rows
    given.unpersist()
    return Weights(rows, n_docs)


def nodes(texts: DataFrame, given) -> DataFrame:
    """(doc_id, content, mass, bands): hash of the word sequence, total weight and band keys; documents without words have none."""

    @settled
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Weights = given.value
        for batch in slices(batches):
            ids, contents, masses, bands = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, tf, words = shingles(text)
                if not len(h):
                    continue
                w = table.of(h, tf)
                place = np.arange(1, len(words) + 1, dtype=np.uint64)
                ids.append(doc_id)
                contents.append(b"".join(int((mixed(words * s + place * BASE).sum(dtype=np.uint64))).to_bytes(8, "big") for s in SEEDS[:2]))
                masses.append(float(w.sum()))
                bands.append(band_keys(signature(h, w, table.rest)).view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary()), pa.array(masses, pa.float64()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "content", "mass", "bands"])

    return texts.mapInArrow(sample, "doc_id long, content binary, mass double, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, given, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose whole texts are similar enough.

    Both joins are between stored tables, so that a text with many partners is split by adaptive execution.
    """

    @F.arrow_udf("double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        table: Weights = given.value
        last: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        out: list[float] = []

        def weighed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            if text not in last:
                if len(last) > 64:
                    last.clear()
                h, tf, _ = shingles(text)
                last[text] = h, table.of(h, tf)
            return last[text]

        for at in range(0, len(left), 500):
            out += [similarity(weighed(a), weighed(b)) for a, b in zip(left.slice(at, 500).to_pylist(), right.slice(at, 500).to_pylist(), strict=True)]
        settle()
        return pa.array(out, pa.float64())

    known = stored(texts.join(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    both = pairs.join(known.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b").join(known.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    return both.where(compare("left", "right") >= threshold * SLACK).select("a", "b")


def crossing(members: DataFrame, texts: DataFrame, given, threshold: float) -> DataFrame:
    """(a, b): of members (doc_id, label, mass), all pairs of different labels that can be similar, by an index on rare shingles.

    Two documents share at least threshold * mass of each, and threshold / (1 + threshold) of their masses' sum. So a document
    goes that has less in common with all other labels together. Of the others' common shingles, in order of how many documents
    have them, only those count from which on there is still that much left: the lighter one of a similar pair has the first
    shingle that they share among those that leave 2 * threshold / (1 + threshold) of its mass, the heavier one among those
    that leave threshold of it. Within a shingle, the largest label's members meet those of other labels, never one another.
    """

    @settled
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Weights = given.value
        for batch in slices(batches, 200):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc_id, text, label, mass in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h, tf, _ = shingles(text)
                for c, x in zip(columns, (h.view(np.int64), table.of(h, tf), np.full(len(h), doc_id), np.full(len(h), label), np.full(len(h), mass)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["shingle", "w", "doc_id", "label", "mass"])

    own = texts.join(members.hint("merge"), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label", "mass")
    rows = stored(own.mapInArrow(explode, "shingle long, w double, doc_id long, label long, mass double"))
    for _ in range(2):  # what only dropped documents shared no longer counts the second time
        counts = stored(rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle", "n"))
        common = stored(rows.drop("n").join(counts, "shingle"))
        keep = common.groupBy("doc_id", "mass").agg(F.sum("w").alias("common")).where(F.col("common") >= F.lit(threshold * SLACK) * F.col("mass")).select("doc_id")
        rows = stored(common.join(keep.hint("merge"), "doc_id", "left_semi"))
    left = F.sum("w").over(Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0))
    index = stored(rows.withColumn("left", left).where(F.col("left") >= F.lit(threshold * SLACK) * F.col("mass")).drop("w", "n"))
    top = index.groupBy("shingle", "label").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count("*").alias("labels"))
    index = stored(index.join(stored(top.where("labels > 1").select("shingle", "top")), "shingle"))
    heavy = index.select("shingle", "top", F.col("doc_id").alias("y"), F.col("label").alias("y_label"), F.col("mass").alias("y_mass"), F.col("left").alias("y_left"))
    light = index.where(F.col("left") >= F.lit(2 * threshold / (1 + threshold) * SLACK) * F.col("mass"))
    can = F.least("left", "y_left") >= F.lit(threshold / (1 + threshold) * SLACK) * (F.col("mass") + F.col("y_mass"))
    can &= (F.col("label") != F.col("y_label")) & ((F.col("y_mass") > F.col("mass")) | (F.col("y_mass") == F.col("mass")) & (F.col("y") > F.col("doc_id")))
    met = light.drop("top").join(heavy.where("y_label <> top"), "shingle").where(can).select("doc_id", "y")
    met = met.union(light.where("label <> top").drop("top").join(heavy.where("y_label = top"), "shingle").where(can).select("doc_id", "y"))
    return met.select(F.least("doc_id", "y").alias("a"), F.greatest("doc_id", "y").alias("b")).distinct()


def classes(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): the smallest node that it is connected with, by large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with class_id, the smallest doc_id among the documents connected by similar texts, and n_links, how many other
    texts this one's was verified to be similar to.

    class_id is null for a null doc_id. If ``docs`` has columns of those names, underscores are appended to the new ones.
    """
    spark, texts = docs.sparkSession, _texts(docs)
    given = spark.sparkContext.broadcast(weights(texts, counters))
    made = stored(nodes(texts, given))
    alike = stored(made.groupBy("content").agg(F.min(F.struct("doc_id", "mass", "bands")).alias("n")).select("content", "n.*"))
    bands = stored(alike.select("doc_id", "mass", F.explode("bands").alias("key")))
    close = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (threshold * SLACK)  # noqa: E731  weighted Jaccard is at most the masses' ratio
    sizes = stored(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    crowded = stored(bands.join(sizes, "key"))
    meets = stored(crowded.groupBy("doc_id").agg(F.sum("n").alias("meets")))
    centres = stored(crowded.join(meets, "doc_id").groupBy("key").agg(F.max(F.struct("meets", (-F.col("doc_id")).alias("back"), "mass")).alias("c")))
    pairs = crowded.join(centres, "key").where((F.col("doc_id") != -F.col("c.back")) & close(F.col("mass"), F.col("c.mass")))
    tested = stored(pairs.select(F.least("doc_id", -F.col("c.back")).alias("a"), F.greatest("doc_id", -F.col("c.back")).alias("b")).distinct())
    links = stored(verified(tested, texts, given, threshold))
    labels = classes(links)

    named = stored(crowded.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "mass", F.coalesce("label", "doc_id").alias("label")))
    mixed_keys = stored(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"))
    members = stored(named.join(mixed_keys, "key", "left_semi").select("doc_id", "label", "mass").distinct())
    more = stored(crossing(members, texts, given, threshold).join(tested, ["a", "b"], "left_anti"))
    links = stored(links.union(verified(more, texts, given, threshold)))
    labels = classes(links)

    degrees = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    named = alike.select("content", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(degrees, "doc_id", "left")
    named = stored(named.select("content", F.coalesce("label", "doc_id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    key, label, count = (fresh(c, docs.columns) for c in ("_id", "_class", "_links"))
    members = stored(made.select("doc_id", "content").join(named.hint("merge"), "content").select(F.col("doc_id").alias(key), F.col("class").alias(label), F.col("n_links").alias(count)))
    final = members.groupBy(key).agg(F.min(label).alias(label), F.max(count).alias(count))
    out = docs.join(final, F.col("doc_id") == F.col(key), "left")
    out = out.withColumn(fresh("class_id", docs.columns), F.coalesce(label, F.col("doc_id").cast("long")))
    return out.withColumn(fresh("n_links", docs.columns), F.coalesce(count, F.lit(0)).cast("long")).drop(key, label, count)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of every class: that of the smallest doc_id. Rows with a null doc_id stay."""
    found = near_duplicates(docs)
    own = found.columns[-2]
    kept = found.where(F.col(own).isNull() | (F.col(own) == F.col("doc_id"))).drop(*found.columns[-2:])
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


QUERIES = {"op5_minhash_near_dedup": query}
ORACLES: dict[str, str] = {}
