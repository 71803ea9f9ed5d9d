"""Operator 11: phrases of two and three words whose parts attract each other.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs; all counts are per
language. The counts are weights of acyclic automata:

1. A task sorts the n-grams of some megabytes of text and builds count transducers from them, one for every range of prefixes (a
   prefix is the first two words, or the only one; its hash gives the range).
2. A range's transducers of all tasks are united and their weights added. Phrases under ``min_count`` end there: parts of a frequent
   phrase are at least as frequent, so what stays has all that follows.
3. Parts are looked up by composition: a range's candidates ask for the counts of their parts, each part once a range; where a part is
   counted, the requests' automaton is composed with the counts'. Requests for a pair carry the largest count of a triple around
   it, so that composition also tells which pairs go because a longer phrase explains them.
4. Scores are exact integers; the first ``top`` of each language are gathered from ever fewer groups, none of more than 16 lists.

A pair or word that a third of all texts hold is one arc a task and range before anything is shuffled.

Defined results: a null text is an empty text; a null lang is ``und``; doc_id isn't used, so that repeated rows and null ids count
like any; texts without words give no phrases; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import read, settle, settled, slices, stored
from stratacut.llm.hashing import mixed
from stratacut.llm.transducers import NONE, WORD, Phrases, Shard, summed

SHARD = 1 << 20  # words
END = b"\xff"  # stands nowhere in UTF-8
PIECES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
U = np.uint64


def words_of(text: bytes) -> list[bytes]:
    """Words, with END between pieces."""
    return text.lower().translate(PIECES).replace(END, b" \xff ").split()


def range_of(hashes: list[np.ndarray], n_ranges: int) -> np.ndarray:
    """The range of a prefix, from the hashes of its one or two words."""
    whole = mixed(hashes[0]) if len(hashes) == 1 else mixed(hashes[0] * U(0x9E3779B97F4A7C15) + hashes[1])
    return (whole % U(n_ranges)).astype(np.int64)


def prefix_range(words: tuple[bytes, ...], n_ranges: int) -> int:
    return int(range_of([np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in words[:2]], n_ranges)[0])


def _shards(tokens: np.ndarray, words: list[bytes], n_ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, transducer) of all n-grams of a sequence of numbers of words, from 1; 0 between pieces."""
    rank = np.empty(len(words) + 1, np.int64)
    order = sorted(range(len(words)), key=words.__getitem__)
    rank[0], rank[np.array(order, np.int64) + 1] = NONE, np.arange(1, len(words) + 1)
    words = [words[k] for k in order]
    t = np.concatenate([rank[tokens], [NONE, NONE]])
    at = np.flatnonzero(t != NONE)
    first, second = t[at], t[at + 1]
    third = np.where(second == NONE, NONE, t[np.minimum(at + 2, len(t) - 1)])
    path, count = np.unique(first << 2 * WORD | second << WORD | third, return_counts=True)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    ones = np.bincount(first, minlength=len(words) + 1)[1:]
    one_range = range_of([hashes], n_ranges)
    first, second, third = path >> 2 * WORD, path >> WORD & (1 << WORD) - 1, path & (1 << WORD) - 1
    pairs = second != NONE
    first, second, third, count = first[pairs], second[pairs], third[pairs], count[pairs]
    path_range = range_of([hashes[first - 1], hashes[second - 1]], n_ranges)
    by_one, by_path = np.argsort(one_range, kind="stable"), np.argsort(path_range, kind="stable")
    one_cuts = np.searchsorted(one_range[by_one], np.arange(n_ranges + 1))
    path_cuts = np.searchsorted(path_range[by_path], np.arange(n_ranges + 1))
    local = np.zeros(len(words) + 1, np.int64)
    for r in range(n_ranges):
        own, p = by_one[one_cuts[r] : one_cuts[r + 1]] + 1, by_path[path_cuts[r] : path_cuts[r + 1]]
        if not len(own) and not len(p):
            continue
        columns = first[p], second[p], third[p]
        used = np.unique(np.concatenate([own, *columns]))
        used = used[used != NONE]
        local[used] = np.arange(1, len(used) + 1)
        yield r, Shard([words[k] for k in (used - 1).tolist()], (local[own], ones[own - 1]), (*(local[c] for c in columns), count[p])).packed()


def counted(docs: DataFrame, n_ranges: int) -> DataFrame:
    """(range, lang, counts): a transducer of a task's n-grams."""

    @settled
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                number, tokens = held.pop(lang)
                parts = list(_shards(np.concatenate(tokens), [w for w in number if w != END], n_ranges))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int64()), pa.array([lang] * len(parts), pa.string()), pa.array([x for _, x in parts], pa.binary())], ["range", "lang", "counts"])

        for batch in slices(batches, 500):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                number, tokens = held.setdefault(lang, ({END: 0}, []))
                words = words_of(text)
                number_of = number.setdefault
                tokens.append(np.array([*[number_of(w, len(number)) for w in words], 0], np.int32))
                size += len(words)
                if size >= SHARD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(build, "range long, lang string, counts binary")


FREQUENT = "range long, lang string, n long, phrases array<binary>, counts array<long>"


def frequent(shards: DataFrame, min_count: int) -> DataFrame:
    """A row a range and language: n, the words' occurrences that the range counts, and the phrases of at least ``min_count`` (words joined by blanks)."""

    def unite(table: pa.Table) -> pa.Table:
        words, ones, pairs, triples = summed(table.column("counts").to_pylist())
        phrases, counts = [], []
        for *columns, count in (ones, pairs, triples):
            often = np.flatnonzero(count >= min_count)
            phrases += [b" ".join([words[k] for k in row]) for row in zip(*(c[often].tolist() for c in columns), strict=True)]
            counts += count[often].tolist()
        settle()
        row = {"range": table.column("range")[0].as_py(), "lang": table.column("lang")[0].as_py(), "n": int(ones[1].sum()), "phrases": phrases, "counts": counts}
        return pa.Table.from_pylist([row], pa.schema([("range", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("phrases", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))]))

    return shards.groupBy("range", "lang").applyInArrow(unite, FREQUENT)


def cuts(words: tuple[bytes, ...]) -> list[tuple[tuple[bytes, ...], tuple[bytes, ...]]]:
    return [(words[:k], words[k:]) for k in range(1, len(words))]


def _phrases(table: pa.Table) -> Iterator[tuple[int, str, list[tuple[tuple[bytes, ...], int]]]]:
    for row in table.to_pylist():
        yield row["range"], row["lang"], [(tuple(p.split(b" ")), c) for p, c in zip(row["phrases"], row["counts"], strict=True)]


def requests(united: DataFrame, n_ranges: int) -> DataFrame:
    """(target, lang, part, source, around): every part that a range's candidates need, once; around: the largest triple with that pair."""

    @settled
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            out = []
            for source, lang, phrases in _phrases(pa.Table.from_batches([batch])):
                wanted = Phrases()
                for words, count in phrases:
                    for parts in cuts(words):
                        for part in parts:
                            wanted.add(part, count if len(part) == 2 else 0)
                out += [{"target": prefix_range(part, n_ranges), "lang": lang, "part": b" ".join(part), "source": source, "around": around} for part, around in wanted]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("target", pa.int64()), ("lang", pa.string()), ("part", pa.binary()), ("source", pa.int64()), ("around", pa.int64())]))

    return united.select("range", "lang", "phrases", "counts").mapInArrow(ask, "target long, lang string, part binary, source long, around long")


def answers(united: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """(source, lang, part, count): count of a part for a range that asked; null: the range's own pair ``part`` goes, a longer phrase explains it."""

    def compose(asks: pa.Table, counts: pa.Table) -> pa.Table:
        own = {}
        for target, lang, phrases in _phrases(counts):
            own[lang] = target, Phrases()
            for words, count in phrases:
                own[lang][1].add(words, count)
        wanted: dict[str, Phrases] = {}
        sources: dict[tuple, list[int]] = {}
        for row in asks.to_pylist():
            part = tuple(row["part"].split(b" "))
            wanted.setdefault(row["lang"], Phrases()).add(part, row["around"])
            sources.setdefault((row["lang"], part), []).append(row["source"])
        out = []
        for lang, phrases in wanted.items():
            target, counts_of = own[lang]
            for part, around, count in phrases.composed(counts_of):
                text = b" ".join(part)
                out += [(s, lang, text, count) for s in sources[lang, part]]
                if 100 * around >= percent * count:
                    out.append((target, lang, text, None))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["source", "lang", "part", "count"])

    return asked.groupBy("target").cogroup(united.groupBy("range")).applyInArrow(compose, "source long, lang string, part binary, count long")


def scores(united: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """(range, lang, down, less, phrase, l, r): a range's first ``top`` of a language; down and less are score and count, negative."""

    def score(parts: pa.Table, counts: pa.Table) -> pa.Table:
        known: dict[str, Phrases] = {}
        gone = set()
        for row in parts.to_pylist():
            part = tuple(row["part"].split(b" "))
            if row["count"] is None:
                gone.add((row["lang"], part))
            else:
                known.setdefault(row["lang"], Phrases()).add(part, row["count"])
        out = []
        for where, lang, phrases in _phrases(counts):
            best = []
            for words, a in phrases:
                if len(words) > 1 and (lang, words) not in gone:
                    sides = [(known[lang].weight(x), known[lang].weight(y)) for x, y in cuts(words)]
                    s, _, (left, right) = min((1_000_000 * a * a // (x * y), k, (x, y)) for k, (x, y) in enumerate(sides))
                    best.append((-s, -a, b" ".join(words), left, right))
            out += [(where, lang, *row) for row in nsmallest(top, best)]
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["range", "lang", "down", "less", "phrase", "l", "r"])

    return found.groupBy("source").cogroup(united.groupBy("range")).applyInArrow(score, "range long, lang string, down long, less long, phrase binary, l long, r long")


def collocations(docs: DataFrame, min_count: int = 10, top: int = 2000, percent: int = 50, n_ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language.

    ``percent``: a pair goes if a triple around it has that share of its count; ``n_ranges``: of prefixes, four a shuffle partition.
    """
    n_ranges = n_ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    united = stored(frequent(counted(docs, n_ranges), min_count))
    found = answers(united, requests(united, n_ranges), percent)
    best, groups = scores(united, found, top), n_ranges
    row = F.struct("down", "less", "phrase", "l", "r")
    while True:  # sixteen lists become one, until a language has one
        groups = -(-groups // 16)
        lists = best.groupBy("lang", F.floor(F.col("range") / 16).alias("range")).agg(F.slice(F.sort_array(F.collect_list(row)), 1, top).alias("of"))
        if groups == 1:
            break
        best = lists.select("range", "lang", F.inline("of"))
    n = united.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = lists.select("lang", F.posexplode("of").alias("at", "of")).join(n, "lang")
    return ranked.select("lang", (F.col("at") + 1).cast("long").alias("rank"), F.col("of.phrase").cast("string").alias("phrase"), (-F.col("of.less")).alias("a"),
                         F.col("of.l").alias("l"), F.col("of.r").alias("r"), "n", (-F.col("of.down")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
with pieces as (select coalesce(lang, 'und') lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
worded as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase
  from worded, (select unnest([1, 2, 3]) k) where len(w) >= k),
f as (select lang, k, phrase, count(*) c from grams group by all),
totals as (select lang, sum(c)::bigint n from f where k = 1 group by lang),
candidates as (select lang, k, phrase, c a, string_split(phrase, ' ') w from f where k > 1 and c >= 10),
cut as (select *, unnest(range(1, k)) cut_at from candidates),
sided as (select x.*, p.c l, q.c r, (1000000::hugeint * a * a // (p.c::hugeint * q.c))::bigint score from cut x
  join f p on p.lang = x.lang and p.phrase = array_to_string(w[1:cut_at], ' ')
  join f q on q.lang = x.lang and q.phrase = array_to_string(w[cut_at + 1:], ' ')),
lowest as (select * from sided qualify row_number() over (partition by lang, phrase order by score, cut_at) = 1),
longer as (select lang, a, array_to_string(w[1:2], ' ') phrase from candidates where k = 3
  union all select lang, a, array_to_string(w[2:3], ' ') from candidates where k = 3),
around as (select lang, phrase, max(a) most from longer group by all),
stay as (select x.* from lowest x left join around y on x.lang = y.lang and x.phrase = y.phrase where most is null or k = 3 or 100 * most < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank, phrase, a, l, r, n, score
from stay join totals using (lang) qualify rank <= 2000
"""

QUERIES = {"op11_collocations": query}
ORACLES = {"op11_collocations": SQL}
