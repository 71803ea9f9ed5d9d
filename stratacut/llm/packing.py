"""Operator 6: pack tokenised documents into sequences of a fixed length, best fit decreasing.

Every document becomes its ids and one end id, cut into pieces of at most ``capacity``. What best fit decreasing does with
a piece depends on its length alone, so the placement is worked out on the histogram of lengths (at most ``capacity`` rows,
whatever the size of the corpus): lengths are taken from long to short, and a segment tree over the remaining capacities
finds the tightest open bins in logarithmic time, a whole run of equal bins at a step. The plan says, per length, which
ranks go to which bins; ranks are dealt out by Spark over (length, bucket) so that a frequent length isn't one task.

Defined results: a null text is an empty text and gives one piece with the end id alone; repeated rows are packed as often as
they occur, pieces of a null doc_id too; an empty table gives an empty result; only the columns of the contract come out, whatever
further columns the documents have.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacut.llm.common import read, settled, slices, stored
from stratacut.llm.hashing import word_bounds, word_hashes

END_ID = 1
RANKED = 50_000  # pieces of one length that one task ranks
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Texts of these characters alone are split by WORD below just as by the tokenizer's own rule: they are stable under NFC,
#: lower case maps one to one, and their white space is plain. No word reaches over white space, so what stands between it can be
#: coded by itself. All other texts go to the library whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ–—‘’“”…]*")
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
MARKS = ".,;:!?"
SEEN = np.arange(256) > ord(" ")
GROUP = 1 << 19  # characters of text that are looked up at a time, or one text
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


class WordIds:
    """Ids of whole texts by a public tokenizer file. What stands between white space is coded once and remembered by a 64-bit hash.

    The memory is a few sorted arrays of at most ``most`` runs (some 40 bytes each); beyond that, those used longest ago go.
    """

    def __init__(self, file: str, most: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads that wait would burn others
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.most, self.turn = most, 0
        self.keys = np.zeros(0, np.uint64)  # sorted; of each run the place and number of its ids, and when it was last used
        self.first = self.size = self.used = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.marks = {m: int(i[0]) for m, i in zip(MARKS, self._library(list(MARKS)), strict=True) if len(i) == 1}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs, one after another, and how many each has: one call for many, cut again after as many ids that end a word as a run has words."""
        # a mark after a letter is a word of its own
        heads = [r[:-1] if r[-1] in self.marks and r[-2:-1].isalpha() else r for r in runs]
        distinct = sorted(set(heads))
        parts, sizes = [], []
        for at in range(0, len(distinct), 256):
            some = distinct[at : at + 256]
            whole = self._library([" ".join(some)])[0]
            last = np.cumsum([1 if x.isalpha() else len(WORD.findall(x)) for x in some])
            ends = np.flatnonzero(self.ends_word[whole]) + 1
            if len(ends) == last[-1]:
                parts.append(whole)
                sizes.append(np.diff(ends[last - 1], prepend=0))
            else:
                each = self._library(some)
                parts += each
                sizes.append(np.array([len(x) for x in each]))
        flat, size = np.concatenate(parts), np.concatenate(sizes)
        nth = dict(zip(distinct, range(len(distinct)), strict=True))
        of = np.array([nth[h] for h in heads])
        mark = np.array([-1 if len(h) == len(r) else self.marks[r[-1]] for h, r in zip(heads, runs, strict=True)])
        total = size[of] + (mark >= 0)
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), "<u4")
        out[spread(begin, size[of])] = flat[spread((np.cumsum(size) - size)[of], size[of])]
        out[(begin + size[of])[mark >= 0]] = mark[mark >= 0]
        return out, total

    def _learn(self, keys: np.ndarray, runs: list[str]) -> None:
        """``keys`` ascend and aren't known yet."""
        ids, size = self._coded(runs)
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(size) - size)
        self.size, self.used = np.insert(self.size, at, size), np.insert(self.used, at, self.turn)
        self.keys, self.ids = np.insert(self.keys, at, keys), np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        self.keys, self.size, self.used = self.keys[keep], self.size[keep], self.used[keep]
        self.ids = self.ids[spread(self.first[keep], self.size)]
        self.first = np.cumsum(self.size) - self.size

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of a few lower-cased plain texts."""
        sizes = np.array([len(t) + 1 for t in texts])
        b = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends = word_bounds(b, SEEN)
        keys, sample, inverse = np.unique(word_hashes(b, starts, ends), return_index=True, return_inverse=True)
        self.turn += 1
        if len(self.keys) > self.most:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], [b[i:j].tobytes().decode() for i, j in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.turn
        first, size = self.first[at][inverse], self.size[at][inverse]
        ids = self.ids[spread(first, size)]
        cuts = np.append(0, np.cumsum(size))[np.searchsorted(starts, np.append(0, np.cumsum(sizes)))].tolist()
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        at = 0
        while at < len(texts):
            held, some = 0, []
            while at + len(some) < len(texts) and held < GROUP:
                held += len(texts[at + len(some)])
                some.append(texts[at + len(some)])
            plain = [PLAIN.fullmatch(t) is not None and not self.special.search(t) for t in some]
            fast = iter(self._group([t.lower().encode() for t, p in zip(some, plain, strict=True) if p]) if any(plain) else ())
            for text, p in zip(some, plain, strict=True):
                yield next(fast) if p else self._library([text])[0]
            at += len(some)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


@lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(file)


def pieces(docs: DataFrame, file: str = "word_bpe_49k.json", capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    @settled
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(file)
        for batch in slices(batches):
            rows: list[tuple[int | None, int, int, int, int]] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, own in zip(batch.column(0).to_pylist(), ids.encode(texts), strict=True):
                coded = own.tobytes() + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, PIECES)


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while a bin with just that much room is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.set = bytearray(2 * self.leaves)
        self.runs: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of bin numbers [from, to)

    def mark(self, room: int) -> None:
        i = room + self.leaves
        self.set[i] = bool(self.runs[room])
        while i > 1:
            i //= 2
            self.set[i] = self.set[2 * i] | self.set[2 * i + 1]

    def add(self, room: int, first: int, end: int) -> None:
        if first < end:
            self.runs[room].append((first, end))
            self.mark(room)

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        i = need + self.leaves
        while not self.set[i]:
            while i & 1:
                if i & (i + 1) == 0:
                    return None  # the right edge
                i //= 2
            i += 1
        while i < self.leaves:
            i *= 2
            i += not self.set[i]
        return i - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self.mark(room)
        return run


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset in the bin) of best fit decreasing over a histogram of lengths.

    The piece of rank r of a length goes to bin ``first bin + (r - first rank) // pieces a bin``.
    """
    bins, made, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, end = made, made + -(-left // each)
                made = end
            else:
                first, end = bins.take(room)
                each = room // length
            full, over = divmod(min(left, (end - first) * each), each)
            rows.append((length, rank, first, each, capacity - room))
            used = full + (over > 0)
            bins.add(room - each * length, first, first + full)
            if over:
                bins.add(room - over * length, first + full, first + full + 1)
            bins.add(room, first + used, end)
            rank, left = rank + full * each + over, left - full * each - over
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset. ``parts`` is read more than once: store it first."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    buckets = max(8, -(-max(histogram.values(), default=0) // RANKED))  # of the commonest length as of any other
    counts = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = counts.groupBy("length", "_bucket").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    table = spark.sparkContext.broadcast(plan(histogram, capacity))

    @F.arrow_udf("struct<sequence_id bigint, offset bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = table.value
        size, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        keys = rows[order, 0] << 48 | rows[order, 1]
        own = rows[order[np.searchsorted(keys, size << 48 | r, "right") - 1]]
        nth, within = np.divmod(r - own[:, 1], own[:, 3])
        return pa.StructArray.from_arrays([pa.array(own[:, 2] + nth), pa.array(own[:, 4] + within * size)], ["sequence_id", "offset"])

    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = counts.withColumn("_nth", F.row_number().over(order) - 1)
    ranked = ranked.join(before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_bucket"])
    placed = ranked.withColumn("_at", place("length", (F.col("_before") + F.col("_nth")).cast("long")))
    return placed.select(*parts.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, file: str = "word_bpe_49k.json", capacity: int = 4096) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and its offset there."""
    return pack(stored(pieces(docs, file, capacity)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op6_best_fit_packing": query}
ORACLES: dict[str, str] = {}
