"""Operator 4: toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents and unlabelled text train two classifiers. A word's evidence is the largest log odds of its features (the
word and its beginnings of 4 to 6 letters), less ``SURE`` standard errors and never below none. Frequencies among clean text aren't seen, so they are those of
unlabelled text less the class prior's share of toxic ones, and never less than none; those of unlabelled text are counted over
all of it by Spark, for every feature that both halves of the toxic examples have (others have no evidence). A document's logit
combines its three strongest words and its mean. This second classifier is trained by gradient on the non-negative risk,
prior * risk(toxic as toxic) + max(0, risk(unlabelled as clean) - prior * risk(toxic as clean)), over all unlabelled documents:
Spark counts how often each combination of its inputs, in steps of ``GRID``, occurs, so the gradient is that of every document,
and takes ``STEPS`` steps at every size.

At most ``POSITIVE`` toxic documents (chosen by hash) are learnt from; scoring is a map over all whole texts. Defined results:
null, empty and wordless texts have the classifier's lowest score; a score is a function of the text, so repeated rows have equal
ones; a row with a null doc_id is scored, counts as unlabelled and isn't held out; without toxic examples every score is 0; an
empty table gives an empty result; further columns pass through, and if one has the new column's name, underscores are appended
to the new one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import crc_of_id, fresh, read, settle, settled, slices
from stratacut.llm.quality import known_share, learnt_from, scored

POSITIVE, STEPS, RATE, SURE = 2000, 800, 0.05, 1.64
TOP, GRID, MOST = 3, 0.25, 8.0
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def words(text: bytes) -> set[str]:
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    parts = [f"{word}$", *(word[:k] for k in STEMS if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in parts]


def features_of(text: bytes) -> np.ndarray:
    return np.unique(np.array([f for w in words(text) for f in features(w)], np.int64))


class Toxicity:
    def __init__(self):
        self.evidence: dict[int, float] = {}
        self.out = np.array([-2.0, 0.6, 0.3, 0.2, 0.0])  # bias, the strongest words', the mean's weight
        self.empty = True
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[w] = max(self.evidence.get(f, 0.0) for f in features(w))
        return got

    def inputs(self, texts: list[bytes]) -> np.ndarray:
        """1, the strongest words' evidence (at least 0, at most ``MOST``) and the mean of all words'."""
        x = np.zeros((len(texts), 2 + TOP))
        x[:, 0] = 1
        for k, text in enumerate(texts):
            if own := list(map(self.word, words(text))):
                top = sorted(own)[: -TOP - 1 : -1]
                x[k, 1 : 1 + len(top)] = top
                x[k, -1] = sum(own) / len(own)
        x[:, 1:] = np.clip(x[:, 1:], [0] * TOP + [-MOST], MOST)
        return x

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.empty:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.inputs(texts) @ self.out, -40, 40)))

    def weigh(self, keys: np.ndarray, positive: np.ndarray, n_positive: np.ndarray, unlabelled: np.ndarray, n_unlabelled: int, prior: float) -> None:
        """Evidence of features ``keys``, from their counts in both halves of the toxic examples and in unlabelled text."""
        odds = []
        u = unlabelled / max(1, n_unlabelled)
        for half in range(2):
            p = positive[half] / max(1, n_positive[half])
            clean = np.maximum(0, u - prior * p) / (1 - prior)
            floor = 1 / max(1, n_positive[half]) + 1 / max(1, n_unlabelled)
            odds.append(np.log((p + floor) / (clean + floor)) - SURE / np.sqrt(positive[half] + 1))
        # the weaker of what two halves say: a word that is in a few toxic documents by chance isn't in as many of others
        weight = np.maximum(0, np.min(odds, 0))
        some = np.flatnonzero(weight)
        self.evidence = dict(zip(keys[some].tolist(), weight[some].tolist(), strict=True))
        self.known = {}

    def fit(self, toxic: np.ndarray, unlabelled: np.ndarray, times: np.ndarray, prior: float) -> None:
        """Gradient steps on the non-negative risk; each row of ``unlabelled`` inputs counts as often as ``times`` says."""
        share = times / times.sum()
        for step in range(STEPS):
            zp, zu = (np.clip(x @ self.out, -40, 40) for x in (toxic, unlabelled))
            qp, qu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # logistic loss: as toxic log(1 + e^-z), as clean log(1 + e^z)
            negative = share @ np.logaddexp(0, zu) - prior * np.logaddexp(0, zp).mean()
            as_clean = (share * qu) @ unlabelled - prior * (qp / len(toxic)) @ toxic
            if negative >= 0:
                g = prior * ((qp - 1) / len(toxic)) @ toxic + as_clean
            else:  # step back from a clean risk below none
                g = -as_clean
            self.out = self.out - 4 * RATE * (1 - step / STEPS) * g
            self.out[1 : 1 + TOP] = np.maximum(self.out[1 : 1 + TOP], [0.2, 0.1, 0.05])  # more evidence is never less toxic


def counted(texts: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` (text) each of the sorted features ``keys`` occurs, and how many texts there are."""
    given = texts.sparkSession.sparkContext.broadcast(keys)

    @settled
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, n_docs = given.value, np.zeros(len(given.value), np.int64), 0
        place = {k: i for i, k in enumerate(own.tolist())}
        known: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found: set[int] = set()
                for w in words(text or b""):
                    got = known.get(w)
                    if got is None:
                        if len(known) > 300_000:
                            known.clear()
                        got = known[w] = [place[f] for f in features(w) if f in place]
                    found.update(got)
                n[list(found)] += 1
                n_docs += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], n_docs))], ["i", "n"])

    sums = texts.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most a row a key
    i, n = (sums.column(k).to_numpy() for k in range(2))
    out = np.zeros(len(keys), np.int64)
    out[i[i >= 0]] = n[i >= 0]
    given.unpersist()
    return out, int(n[i < 0].sum())


def combinations(texts: DataFrame, model: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all ``texts`` in steps of ``GRID``, and how often each occurs: at most as many rows as the grid has places."""
    given = texts.sparkSession.sparkContext.broadcast(model)

    @settled
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, ...], int] = {}
        for batch in slices(batches):
            for row in np.round(given.value.inputs([t or b"" for t in batch.column(0).to_pylist()])[:, 1:] / GRID).astype(int).tolist():
                seen[tuple(row)] = seen.get(tuple(row), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())], ["x", "n"])

    sums = texts.mapInArrow(count, "x array<int>, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").toArrow()
    x = np.array(sums.column(0).to_pylist(), float).reshape(-1, 1 + TOP) * GRID
    return np.concatenate([np.ones((len(x), 1)), x], 1), sums.column(1).to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE) -> Toxicity:
    """``labels`` (doc_id, toxic): 1 is a confirmed example and gives, over all labels, the class prior; no other label is used."""
    model = Toxicity()
    chosen = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(positive)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("text"))

    @F.arrow_udf("array<bigint>")
    def coded(data: pa.Array) -> pa.Array:
        return pa.array([features_of(t or b"").tolist() for t in data.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("array<double>")
    def inputs(data: pa.Array) -> pa.Array:
        found = given.value.inputs([t or b"" for t in data.to_pylist()]).tolist()
        settle()
        return pa.array(found, pa.list_(pa.float64()))

    toxic = texts.join(F.broadcast(chosen), "_id")
    half = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(2)).alias("half")
    rows = toxic.select(half, F.explode(coded("text")).alias("f")).groupBy("f").agg(*[F.sum((F.col("half") == h).cast("long")).alias(f"n{h}") for h in range(2)])
    rows = rows.where("n0 > 0 and n1 > 0").orderBy("f").toArrow()  # features of both halves of the examples
    keys, seen = rows.column(0).to_numpy(), np.array([rows.column(k).to_numpy() for k in (1, 2)], float)
    sizes = {r["half"]: r["count"] for r in toxic.select(half).groupBy("half").count().collect()}
    if not len(keys):
        return model
    prior = known_share(labels, "toxic")
    unlabelled, n = counted(texts.select("text"), keys)
    model.weigh(keys, seen, np.array([sizes.get(0, 0), sizes.get(1, 0)]), unlabelled, n, prior)
    given = docs.sparkSession.sparkContext.broadcast(model)
    own = np.array(sorted(toxic.select(inputs("text").alias("x")).toArrow().column(0).to_pylist()), float)  # at most ``positive`` short rows
    model.fit(own, *combinations(texts.select("text"), model), prior)
    model.empty = False
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with toxic_score (0 to 1), learnt from toxic examples in ``labels`` and ``docs`` as unlabelled text."""
    return scored(docs, train(docs, labels), fresh("toxic_score", docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    out = scored(docs, train(*learnt_from(docs, labels, 4, 2)), "score")
    held = F.coalesce(crc_of_id(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": query}
ORACLES: dict[str, str] = {}
