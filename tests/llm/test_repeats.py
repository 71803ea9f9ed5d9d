import hashlib

import numpy as np
import pytest

from stratacut.llm import repeats, suffix_order


def plain(rows):
    """(id, var) -> merged spans, by a dictionary of all windows."""
    first, texts = {}, {}
    for doc_id, text in rows:
        t = (text or "").encode()
        texts[repeats.LAST if doc_id is None else doc_id, _crc(t)] = t
    for place in sorted(texts):
        t = texts[place]
        for p in range(len(t) - 99):
            first.setdefault(t[p : p + 100], (*place, p))
    out = {}
    for place, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] != (*place, p):
                gone[p : p + 100] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
        out[place] = (len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])).hexdigest())
    return out


def _crc(t):
    import zlib

    return zlib.crc32(t)


def found(df):
    return sorted((repeats.LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def expected(rows):
    by = plain(rows)
    return sorted((repeats.LAST if i is None else i, *by[repeats.LAST if i is None else i, _crc((t or "").encode())]) for i, t in rows)


def test_whole_table_equals_all_windows(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.query(spark, sf).collect())
    assert out == expected(rows)
    assert sum(r[2] for r in out) > 0


@pytest.mark.parametrize(("hot", "hot_here"), [(1000, 64), (2, 64), (1000, 2), (5, 3)])
def test_hot_anchors_and_borders(spark, hot, hot_here):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(2, 9)))
    line = "".join(word() for _ in range(60))[:140]
    rows = [(i, "".join(word() for _ in range(30)) + line[: rng.integers(95, 141)] + "".join(word() for _ in range(30))) for i in range(60)]
    rows += [(100, "ab" * 500), (101, "ab" * 300), (102, "a" * 700), (103, "a" * 99), (104, "a" * 100), (105, "x" + "a" * 250), (106, None), (107, ""), (3, rows[7][1]), (8, rows[8][1]), (9, line), (None, line), (None, rows[1][1] + line)]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, n_bytes int, kept string").repartition(7)
    out = repeats.drop_repeats(docs, hot=hot, hot_here=hot_here)
    assert out.columns == ["doc_id", "text", "n_bytes", "kept", "kept_", "n_bytes_", "n_removed", "spans"]
    got = out.drop("n_bytes", "kept").withColumnsRenamed({"kept_": "kept", "n_bytes_": "n_bytes"})
    assert found(got) == expected(rows)


def test_long_text_and_empty_table(spark):
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)).decode()
    rows = [(1, base + base[1_000_000:1_100_000]), (2, base[400_000:900_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, [(s.start, s.end) for s in r.spans]) for r in repeats.drop_repeats(docs).collect()) == [(1, 100_000, [(1_300_000, 1_400_000)]), (2, 500_000, [(0, 500_000)])]
    assert repeats.drop_repeats(docs.limit(0)).count() == 0


def test_anchors_depend_on_their_window_alone():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    for body in (text, b"zz" + text[500:1500] + b"yy", b"a" * 400):
        of, start, runs, distance, _ = repeats.anchors([body, b"short", body])
        windows = np.concatenate([np.arange(s, s + n) for s, n in zip(start[of == 0], runs[of == 0], strict=True)])
        assert windows.tolist() == list(range(len(body) - 99))
        assert (distance + 0 >= 0).all() and set(of.tolist()) == {0, 2}
    of, start, runs, distance, h = repeats.anchors([text, text[500:1500]])
    place = {}
    for o, s, n, d, k in zip(of.tolist(), start.tolist(), runs.tolist(), distance.tolist(), h.tolist(), strict=True):
        for w in range(s, s + n):
            place[o, w] = (s + d - w, k)
    assert all(place[1, w] == place[0, 500 + w] for w in range(901))


@pytest.mark.parametrize("options", [{}, {"memory": 7}, {"base": 0}, {"memory": 5, "base": 0}])
def test_suffix_order_equals_sorting(options):
    rng = np.random.default_rng(6)
    for trial in range(120):
        t = rng.integers(1, 2 + rng.integers(1, 5), rng.integers(1, 90))
        text = np.r_[np.tile(t, 1 + trial % 4), 0].astype(np.uint8)
        raw = bytes(text)
        order = sorted(range(len(raw) - 1), key=lambda i: raw[i:])
        common = [0] + [next((k for k in range(100) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1]), 100) for a, b in zip(order, order[1:], strict=False)]
        blocks = list(suffix_order.suffix_blocks(text, **options))[::-1]
        positions, lcps = (np.concatenate(x) for x in zip(*blocks, strict=True))
        inside = positions < len(raw) - 1
        assert positions[inside].tolist() == order and lcps[inside].tolist() == common
