"""Operator 3: document quality by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded and pass a learned convolution (``WIDE`` bytes, every second byte); the filters' largest
values in overlapping chunks of 256 bytes, which cover the whole text, go through a small dense layer to a logit per chunk, and
mean, extremes and spread of these logits are combined into one probability. The network is fitted on the driver to
``CHUNKS`` random chunks of each of at most ``PER_CLASS`` labelled documents a class (chosen by hash); the combination is fitted
to the same documents whole, scored by Spark. Scoring is a map: the model is broadcast, a few dozen kilobytes.

Defined results: a null or empty text is scored as one chunk of padding; a score is a function of the text alone, so repeated rows
and equal texts have equal scores; a row with a null doc_id is scored, not learnt from and not held out; of several labels of a
document the largest counts; labels that are null or neither 0 nor 1 are not learnt from; without labels of both classes every
score is the share of label 1 (or 0.5 without any labels); an empty table gives an empty result; further columns pass through,
and if one has the new column's name, underscores are appended to the new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import crc_of_id, fresh, read, settle

PER_CLASS, CHUNKS, EPOCHS = 2000, 3, 14
HALF, WIDE, STEP, EMBED, FILTERS, HIDDEN = 128, 6, 2, 8, 24, 16
PAD = 256
GROUP = 1 << 20


def windows(b: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """Embedded windows of rows of bytes (a row: whole halves and WIDE bytes more), one row for each window."""
    x = embed[b]
    n = (b.shape[1] - WIDE) // STEP
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(b), n, WIDE * EMBED), (s[0], s[1] * STEP, s[2]))


class ByteNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.p = {"embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), "filters": draw(WIDE * EMBED, FILTERS), "shift": np.zeros(FILTERS, np.float32), "w": draw(FILTERS, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}
        self.p["embed"][PAD] = 0
        self.mix = np.array([0, 1, 0, 0, 0, 0], float)  # bias; weights of mean, most, least, spread, share
        self.constant: float | None = None

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = np.maximum(pooled, 0)
        hidden = np.tanh(r @ self.p["w"] + self.p["b"])
        return r, hidden, (hidden * self.p["v"]).sum(1) + self.p["c"]

    def fit(self, chunks: np.ndarray, labels: np.ndarray, weight: np.ndarray, seed: int = 4) -> None:
        """Adam on the weighted logistic loss; gradients pass the windows that the largest values come from."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for k, x in self.p.items():
            m[k], v[k] = np.zeros_like(x), np.zeros_like(x)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(chunks))
            for a in range(0, len(order), 64):
                own = order[a : a + 64]
                b = chunks[own]
                x = windows(b, self.p["embed"])
                conv = x.reshape(-1, WIDE * EMBED) @ self.p["filters"]
                conv = conv.reshape(len(own), -1, FILTERS)
                best = conv.argmax(1)
                pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0] + self.p["shift"]
                r, hidden, z = self.head(pooled)
                dz = (1 / (1 + np.exp(-z)) - labels[own]) * weight[own] / len(own)
                g = {"v": hidden.T @ dz, "c": np.array([dz.sum()])}
                dh = dz[:, None] * self.p["v"] * (1 - hidden**2)
                g["w"], g["b"] = r.T @ dh, dh.sum(0)
                dp = (dh @ self.p["w"].T) * (pooled > 0)
                g["shift"] = dp.sum(0)
                rows = np.arange(len(own))[:, None]
                top = x[rows, best]  # chunk, filter, window
                g["filters"] = np.einsum("nfk,nf->kf", top, dp)
                dx = dp[:, :, None] * self.p["filters"].T
                at = b[rows[:, :, None], best[:, :, None] * STEP + np.arange(WIDE)]
                g["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(g["embed"], at.ravel(), dx.reshape(-1, EMBED))
                g["embed"][PAD] = 0
                t += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
                for k, x_ in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    x_ -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def summaries(self, texts: list[bytes]) -> np.ndarray:
        """Mean, most, least, spread of the chunks' logits and the share above 0, for each whole text."""
        halves = [max(1, -(-len(t) // HALF)) for t in texts]
        # after its last half each text has as much padding as a window reads on, so no text sees the next one
        begins = np.cumsum([0, *(n * HALF + WIDE for n in halves)])
        flat = np.full(int(begins[-1]), PAD, np.int16)
        for t, at in zip(texts, begins.tolist(), strict=False):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        total = sum(halves)
        first_half = np.cumsum(halves) - halves
        rows_at = np.repeat(begins[:-1] - first_half * HALF, halves) + np.arange(total) * HALF
        pooled = np.empty((total, FILTERS), np.float32)
        index = np.arange(HALF + WIDE)
        for a in range(0, total, 512):
            rows = flat[rows_at[a : a + 512, None] + index]
            if len(rows) < 512:  # one shape for all
                rows = np.concatenate([rows, np.full((512 - len(rows), HALF + WIDE), PAD, np.int16)])
            x = windows(rows, self.p["embed"])
            pooled[a : a + 512] = (x.reshape(-1, WIDE * EMBED) @ self.p["filters"]).reshape(512, -1, FILTERS).max(1)[: total - a]
        pooled += self.p["shift"]
        last = np.cumsum(halves) - 1
        # a chunk is a half and the next one; a text's last half has no next, so it counts alone only if it's the only one
        paired = np.maximum(pooled, np.concatenate([pooled[1:], pooled[-1:]]))
        keep = np.ones(total, bool)
        several = np.array(halves) > 1
        keep[last[several]] = False
        paired[last[~several]] = pooled[last[~several]]
        chosen = paired[keep]
        blocks = np.zeros((-(-len(chosen) // 512) * 512, FILTERS), np.float32)
        blocks[: len(chosen)] = chosen
        z = np.concatenate([self.head(blocks[a : a + 512])[2] for a in range(0, len(blocks), 512)])[: len(chosen)].astype(float)
        counts = np.where(several, np.array(halves) - 1, 1)
        first = np.cumsum(counts) - counts
        mean = np.add.reduceat(z, first) / counts
        square = np.add.reduceat(z * z, first) / counts
        return np.stack([mean, np.maximum.reduceat(z, first), np.minimum.reduceat(z, first), np.sqrt(np.maximum(0, square - mean**2)), np.add.reduceat((z > 0).astype(float), first) / counts], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        # products of matrices differ by 1e-7 with a row's place in them; four decimals don't
        z = np.round((self.summaries(texts) * self.mix[1:]).sum(1) + self.mix[0], 4)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Bias and weights by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (p - y)) + keep @ w)
    return w


def in_groups(texts: list[bytes]) -> Iterator[slice]:
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + HALF
        if held >= GROUP:
            yield slice(at, k + 1)
            at, held = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, y): at most ``per_class`` labelled documents of each class, by hash of the id; a document's label is its largest."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return texts.join(F.broadcast(chosen[0].union(chosen[1])), "_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> ByteNet:
    spark, net = docs.sparkSession, ByteNet()
    sample = sample_of(docs, labels, label, per_class)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * HALF + WIDE
        for batch in batches:
            out, ys = [], []
            for doc_id, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rng = np.random.default_rng(abs(doc_id))
                for _ in range(CHUNKS):
                    at = int(rng.integers(0, max(1, len(text) // HALF - 1))) * HALF
                    out.append(text[at : at + size])
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ys, pa.int32())], ["chunk", "y"])

    rows = sample.select(F.col("_id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(cut, "chunk binary, y int").collect()  # at most 2 * per_class * CHUNKS short rows
    rows.sort(key=lambda r: (bytes(r["chunk"]), r["y"]))
    y = np.array([r["y"] for r in rows], np.float32)
    if len(np.unique(y)) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    chunks = np.full((len(rows), 2 * HALF + WIDE), PAD, np.int16)
    for k, r in enumerate(rows):
        chunks[k, : len(r["chunk"])] = np.frombuffer(r["chunk"], np.uint8)
    chunks[:, 2 * HALF :] = np.where(chunks[:, 2 * HALF :] == PAD, PAD, chunks[:, 2 * HALF :])
    net.fit(chunks, y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).astype(np.float32))
    given = spark.sparkContext.broadcast(net)

    @F.arrow_udf("array<double>")
    def look(texts: pa.Array) -> pa.Array:
        data = texts.to_pylist()
        found = [row for s in in_groups(data) for row in given.value.summaries(data[s]).tolist()]
        settle()
        return pa.array(found, pa.list_(pa.float64()))

    seen = sorted((r["s"], r["y"]) for r in sample.select(look("text").alias("s"), "y").collect())  # at most 2 * per_class rows
    share = known_share(labels, label)
    y = np.array([r[1] for r in seen], float)
    x = np.array([r[0] for r in seen])
    net.mix = logistic(x, y, np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y))
    return net


def known_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among the labels, clear of 0 and 1."""
    n, ones = labels.where(F.col(label).isin(0, 1)).agg(F.count("*"), F.sum(label)).first()
    return min(0.999, max(0.001, (ones or 0) / max(1, n)))


def scored(docs: DataFrame, model, column: str) -> DataFrame:
    """``docs`` with a score of every whole text by ``model.score``."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 1000):
            data = [t or b"" for t in texts.slice(at, 1000).cast(pa.binary()).to_pylist()]
            out += [given.value.score(data[s]) for s in in_groups(data)]
        settle()
        return pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())

    return docs.withColumn(column, score("text"))


def learnt_from(docs: DataFrame, labels: DataFrame, modulus: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Both without the rows that are held out."""
    return tuple(x.where(crc_of_id(F.col("doc_id"), modulus) != held) for x in (docs, labels))  # type: ignore[return-value]


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with quality_score (0 to 1), by a network learnt from ``labels`` (doc_id, quality)."""
    return scored(docs, train(docs, labels), fresh("quality_score", docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    out = scored(docs, train(*learnt_from(docs, labels, 3, 1)), "score")
    return out.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": query}
ORACLES: dict[str, str] = {}
