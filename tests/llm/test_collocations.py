import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratacut.llm import collocations as co
from stratacut.llm.transducers import Phrases, Shard, summed


def plain(rows, min_count=10, top=2000, percent=50):
    """All n-grams in one counter a language."""
    f = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        candidates = {w: c for w, c in counts.items() if len(w) > 1 and c >= min_count}
        found = []
        for words, a in candidates.items():
            if any(len(x) > len(words) and 100 * c >= percent * a and words in (x[:2], x[1:]) for x, c in candidates.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[words[:k]] * counts[words[k:]]), k, counts[words[:k]], counts[words[k:]]) for k in range(1, len(words)))
            found.append((-score, -a, " ".join(words).encode(), left, right))
        out += [(lang, at, p.decode(), -a, left, right, n, -s) for at, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_odd_rows_ties_and_hot_pairs(spark):
    rng = np.random.default_rng(1)
    words = ["a", "B", "cé", "d'", "e-f", " g", "h\x1ci", "漢", "x" * 300]
    rows = [(None, "en"), ("", None), ("...\n\t ,", "fr"), ("one Two THREE. one two", None)]
    rows += [(" ".join(rng.choice(words, 40)) + rng.choice([".", "\t", "\r\n", "\x0b"]) + " ".join(rng.choice(words[:4], 30)), rng.choice(["en", "de", "xx"])) for _ in range(60)]
    rows += [("Hot pair here", "en")] * 40 + [("hot pair there", None)] * 12 + [("Solo words " * 30_000, "de")]
    docs = spark.createDataFrame([(i % 7, *r, 1, "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, range int, n string").repartition(9)
    for options in ({}, {"min_count": 3, "top": 7, "n_ranges": 40}, {"n_ranges": 1, "percent": 90}):
        out = co.collocations(docs, **options)
        assert found(out) == plain(rows, **{k: v for k, v in options.items() if k != "n_ranges"})
    assert co.collocations(docs.limit(0)).count() == 0
    assert co.collocations(docs.where("text is null")).count() == 0


def test_whole_table(spark, sf):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert found(co.query(spark, sf)) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from([b"a", b"b", b"cc", b"d"]), max_size=9), max_size=6), min_size=1, max_size=4))
def test_united_shards_hold_all_counts(shards):
    expect, got = Counter(), Counter()
    packed = defaultdict(list)
    for pieces in shards:
        number, tokens = {}, []
        for piece in pieces:
            tokens += [*(number.setdefault(w, len(number) + 1) for w in piece), 0]
            expect.update(tuple(piece[i : i + k]) for k in (1, 2, 3) for i in range(len(piece) - k + 1))
        for r, data in co._shards(np.array(tokens, np.int64), list(number), 3) if number else []:
            packed[r].append(data)
    for r, parts in packed.items():
        words, *levels = summed(parts)
        for *columns, count in levels:
            for c, *row in zip(count.tolist(), *columns, strict=True):
                phrase = tuple(words[k] for k in row)
                assert phrase not in got and co.prefix_range(phrase, 3) == r
                got[phrase] = c
    assert got == expect


def test_states_with_equal_arcs_are_one():
    paths = (np.array([1, 1, 1, 2, 2, 2, 3]), np.array([1, 2, 2, 1, 2, 2, 3]), np.array([3, 0, 3, 3, 0, 3, 3]), np.array([5, 1, 2, 5, 1, 2, 4]))
    one = Shard([b"x", b"y", b"z"], (np.array([1, 2]), np.array([7, 8])), paths)
    back = Shard.unpacked(one.packed())
    assert back.words == one.words and all((a == b).all() for a, b in zip(back.paths, paths, strict=True))
    assert Shard.unpacked(Shard([b"x"], (np.array([1]), np.array([2])), (np.zeros(0, int),) * 4).packed()).ones[1].tolist() == [2]


def test_composition_walks_common_arcs():
    a, b = Phrases(), Phrases()
    for words, w in (((b"x",), 1), ((b"x", b"y"), 2), ((b"x", b"y"), 5), ((b"q",), 9)):
        a.add(words, w)
    for words, w in (((b"x", b"y"), 7), ((b"x", b"z"), 8), ((b"q", b"r"), 1)):
        b.add(words, w)
    assert list(a.composed(b)) == [((b"x", b"y"), 5, 7)]
    assert list(a) == [((b"q",), 9), ((b"x",), 1), ((b"x", b"y"), 5)] and a.weight((b"x", b"z")) is None
