import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratacut.llm import line_dedup, packing

LONG = "a line that is long enough"


def best_fit(lengths, capacity):
    """Plain best fit decreasing: how many bins, and the multiset of their contents."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    for length, first_rank, first_bin, each, offset in packing.plan(histogram, 40):
        ends = [r[1] for r in packing.plan(histogram, 40) if r[0] == length and r[1] > first_rank]
        for rank in range(first_rank, min(ends, default=histogram[length])):
            n, k = divmod(rank - first_rank, each)
            used.setdefault(first_bin + n, []).append((offset + k * length, length))
    room = []
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 40
        room.append(40 - at)
    assert sorted(room) == best_fit(lengths, 40)


def test_packing_whole_and_gapless(spark, sf):
    rows = packing.query(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
    assert parts.keys() == docs.keys()
    for k, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted(parts[k], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == len(best_fit([r.length for r in rows], 4096))


def test_word_ids_equal_the_library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "Hello, World! don't can't I'LL", "É́ ﬁ x\x00y ΑΣ straße ² ¾ 12 3", "a<|endoftext|>b", " x\x1cy\x85z", "ÀÉÖ „quote“ — dash…", "'s ''s !'s x'", "漢字 كتاب"]
    expect = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [i.tobytes() for i in packing.WordIds("word_bpe_49k.json").encode(texts)] == expect
    assert [i.tobytes() for i in packing.WordIds("word_bpe_49k.json", most=3).encode(texts)] == expect


def test_packing_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "word " * 9000, 2), (3, "word " * 9000, 3), (None, "x", 4)], "doc_id long, text string, sequence_id int")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == sorted([(0, 2), (1, 1), (2, 1)] + [(3, 4096), (3, 4096), (3, 809)] * 2)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_line_dedup_edges(spark):
    rows = [(1, f"{LONG}\nown 1"), (2, f" {LONG.upper()}\t\nshort"), (3, f"{LONG}\n{LONG}\nshort"), (3, f"{LONG}\nagain"), (4, None), (5, ""), (6, "short"), (None, LONG), (7, "é" * 19), (8, "é" * 19), (9, "é" * 19)]
    docs = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, n_lines int, key string")
    out = sorted((r.doc_id or 0, r.text, r.n_lines_, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    assert out == sorted([(0, LONG, 1, 0), (1, "own 1", 2, 1), (2, "short", 2, 1), (3, f"{LONG}\n{LONG}\nshort", 3, 0), (3, f"{LONG}\nagain", 2, 0), (4, "", 1, 0), (5, "", 1, 0), (6, "short", 1, 0), (7, "é" * 19, 1, 0), (8, "é" * 19, 1, 0), (9, "é" * 19, 1, 0)])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
