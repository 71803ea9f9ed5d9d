from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratacut.llm import near_dedup as nd


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs with plain dictionaries."""
    import re

    def shingled(text):
        ws = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else Counter()

    made = [(d, shingled(t)) for d, t in rows]
    df = Counter(s for _, c in made for s in c)
    n = sum(1 for _, t in rows if t is not None)
    made = [(d, {s: k * (1 - np.log(max(df[s] / n, nd.RARE))) for s, k in c.items()}) for d, c in made]
    label = {d: d for d, _ in made}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(made):
        for b, y in made[:i]:
            if x and y and (common := x.keys() & y.keys()):
                low = sum(min(x[s], y[s]) for s in common)
                if low / (sum(x.values()) + sum(y.values()) - low) >= threshold:
                    p, q = find(a), find(b)
                    label[max(p, q)] = min(p, q)
    return {d: find(d) for d in label}


def test_classes_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs, counters=8).collect()} == brute(rows)  # counters are doubled until they suffice


def test_edges(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(5, long, 1), (9, long.upper() + "!", 1), (9, long, 2), (7, long + " one", 1), (3, None, 1), (2, "", 1), (1, "...", 1), (8, "two words", 1), (4, "Two, words", 1), (None, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    out = nd.near_duplicates(docs)
    assert out.columns == ["doc_id", "text", "class_id", "class_id_", "n_links"]
    assert {r.doc_id: r.n_links for r in out.collect() if r.doc_id in (5, 7, 8, None)} == {5: 1, 7: 1, 8: 0, None: 0}
    assert sorted(((r[0] or 0), r[3] or 0) for r in out.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 5), (8, 4), (9, 5), (9, 5)]
    assert sorted(r.doc_id or 0 for r in nd.one_of_each(docs).collect()) == [0, 1, 2, 3, 4, 5]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), max_size=40), min_size=1, max_size=6), st.integers(1, 10))
def test_summary_keeps_every_frequent_key(parts, most):
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in parts:
        keys, counts = nd._heaviest(np.concatenate([keys, np.array(part, np.uint64)]), np.concatenate([counts, np.ones(len(part), np.int64)]), most)
        assert len(keys) <= most
    total = sum(map(len, parts))
    assert {k for k, n in Counter(x for p in parts for x in p).items() if n > total / (most + 1)} <= set(keys.tolist())


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(1, 1 << 63, 400, dtype=np.uint64))
    a, b = h[:340], h[60:]
    wa, wb = np.where(a % 3 == 0, 2.0, 5.0), np.where(b % 3 == 0, 4.0, 5.0)
    agree = (nd.signature(a, wa, 5.0) == nd.signature(b, wb, 5.0)).mean()
    assert agree == pytest.approx(nd.similarity((a, wa), (b, wb)), abs=0.13)
    assert (nd.signature(a, wa, 5.0) == nd.signature(a, wa, 7.0)).all()


def test_chains_have_one_class(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r.node: r.label for r in nd.classes(links).collect()}
    assert got == {k: 1 for k in range(2, 61)} | {99: 98, 100: 98}


def test_index_proposes_every_similar_pair(spark):
    """Copies of a few texts with edits, cuts and mixtures, all with labels of their own: brute force over all pairs finds no other link."""
    rng = np.random.default_rng(8)
    bases = [[f"{k}w{rng.integers(400)}" for _ in range(90)] for k in range(3)]
    rows = []
    for doc in range(260):
        ws = list(bases[rng.integers(3)])
        for _ in range(rng.integers(0, 9)):
            ws[rng.integers(len(ws))] = f"e{rng.integers(6)}"
        if rng.random() < 0.3:
            ws = ws[: rng.integers(50, 90)]
        if rng.random() < 0.2:
            ws += bases[rng.integers(3)][:20]
        rows.append((doc, " ".join(ws)))
    texts = nd._texts(spark.createDataFrame(rows, "doc_id long, text string"))
    table = nd.weights(texts)
    given = spark.sparkContext.broadcast(table)
    weighed = {d: (x[0], table.of(x[0], x[1])) for d, t in rows for x in [nd.shingles(t.encode())]}
    label = {d: d // 3 for d, _ in rows}
    members = spark.createDataFrame([(d, label[d], float(w.sum())) for d, (_, w) in weighed.items()], "doc_id long, label long, mass double")
    pairs = nd.crossing(members, texts, given, 0.8)
    got = {(r.a, r.b) for r in nd.verified(pairs, texts, given, 0.8).collect()}
    expect = {(a, b) for a in weighed for b in weighed if a < b and label[a] != label[b] and nd.similarity(weighed[a], weighed[b]) >= 0.8}
    assert got == expect and len(expect) > 100
    assert pairs.count() < 0.5 * 260 * 259 / 2


def test_a_large_group_with_edits(spark):
    """Most rows are copies of one text; links that a comparison with the origin can't see are found too."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(base)) for k in range(60)]
    for k in range(60, 140):
        ws = list(base)
        for at in rng.choice(80, rng.integers(1, 6), replace=False):
            ws[at] = f"e{k}x{at}" if k % 2 else f"e{at}"
        rows.append((k, " ".join(ws)))
    rows += [(k, " ".join(f"u{k}v{j}" for j in range(60))) for k in range(140, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()} == brute(rows)
