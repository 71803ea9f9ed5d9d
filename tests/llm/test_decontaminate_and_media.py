import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratacut.llm import decontaminate, flac, media


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_array(symbols):
    s = np.array(symbols)
    assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), max_size=5))
def test_search_finds_every_occurrence(docs, items):
    block = decontaminate.Windows.of([(str(k), b" ".join(x)) for k, x in enumerate(items)], 4)
    doc, at, window = decontaminate.search(docs, block)
    words = sorted(block.number, key=block.number.get)
    patterns = [[words[x - 1] for x in p[:n]] for p, n in zip(block.patterns, block.lengths, strict=True)]
    expect = sorted((d, i, k) for d, ws in enumerate(docs) for k, p in enumerate(patterns) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p)
    assert sorted(zip(doc.tolist(), at.tolist(), window.tolist(), strict=True)) == expect
    spans = decontaminate.spans_of([len(d) for d in docs], doc, at, block.lengths[window])
    for d, own in enumerate(spans):
        hit = {p for e, i, k in expect if e == d for p in range(i, i + len(patterns[k]))}
        assert {p for a, b in own for p in range(a, b)} == hit


def test_leaks_in_blocks_and_cut(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"before {long.upper()}, after", 7), (2, None, 7), (2, "short item here", 7), (3, "", 7), (3, "nothing", 7)], "doc_id long, text string, spans int")
    benchmark = spark.createDataFrame([(10, long, 1), (9, "Short  item", 1), (8, None, 1), (7, "...", 1), (None, "nothing", 1)], "item_id long, text string, text2 int")
    for block in (200_000, 3):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        out = sorted(decontaminate.leaks(docs, benchmark).collect(), key=lambda r: (r.doc_id, r.n_words))  # rows come in any order
        assert [(r.doc_id, r.n_words, [tuple(s) for s in r.spans_], r["items"]) for r in out] == [(1, 32, [(1, 31)], ["10"]), (2, 0, [], []), (2, 3, [(0, 2)], ["9"]), (3, 0, [], []), (3, 1, [], [])]
        cut = decontaminate.cut(docs, benchmark).collect()
        assert sorted(((r.doc_id, r.text) for r in cut), key=repr) == sorted([(1, "before , after"), (2, None), (2, " here"), (3, ""), (3, "nothing")], key=repr)
    assert decontaminate.leaks(docs, benchmark.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["text", "noise", "flat", "wave", "utf8"])), min_size=1, max_size=6), st.randoms())
def test_flac_round_trip_both_ways(kinds, rnd):
    made = []
    for n, kind in kinds:
        size = 192 * n
        made.append({
            "text": lambda: bytes(rnd.choice(b"etaoin shrdlu") for _ in range(size)),
            "noise": lambda: bytes(rnd.randrange(256) for _ in range(size)),
            "flat": lambda: bytes([rnd.randrange(256)]) * size,
            "wave": lambda: bytes(int(128 + 100 * np.sin(k / 9)) for k in range(size)),
            "utf8": lambda: ("é漢a b" * size).encode()[:size],
        }[kind]())
    streams = flac.encode(made)
    for data, stream, got in zip(made, streams, flac.decode_all(streams), strict=True):
        assert (got + 128).astype(np.uint8).tobytes() == data
        assert (flac.decode(stream) == got).all()


def bits(*fields):
    s = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    return int(s + "0" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8, "big")


def test_decode_other_makes():
    """A stereo frame of 16 samples: mid and side, two partitions and an escape, and a linear predictor."""
    left = [100 + 3 * k + (k % 3) for k in range(16)]
    right = [90 + 2 * k - (k % 2) for k in range(16)]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right, strict=True)], [a - b for a, b in zip(left, right, strict=True)]
    head = bits((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (10, 4), (0, 3), (0, 1), (0, 8), (15, 8))
    head += bytes([flac._crc(head, flac.CRC8.tolist(), 8)])
    rice = lambda r, k: [(0, (r << 1 if r >= 0 else -2 * r - 1) >> k), (1, 1), (r << 1 if r >= 0 else -2 * r - 1, k)]
    d = [b - a for a, b in zip(mid, mid[1:], strict=False)]
    first = [(0, 1), (9, 6), (0, 1), (mid[0], 16), (0, 2), (1, 4), (2, 4), *[f for r in d[:7] for f in rice(r, 2)], (15, 4), (5, 5), *[(r, 5) for r in d[7:]]]
    guess = [side[k] - (side[k - 1] * 60 >> 6) for k in range(1, 16)]
    second = [(0, 1), (32, 6), (0, 1), (side[0], 17), (7, 4), (6, 5), (60, 8), (1, 2), (0, 4), (3, 5), *[f for r in guess for f in rice(r, 3)]]
    frame = head + bits(*[f for f in first + second if f[1]])
    frame += flac._crc(frame, flac.CRC16.tolist(), 16).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 15 << 36 | 16).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80\x00\x00\x22" + info + frame
    assert flac.decode_all([stream])[0].reshape(16, 2).tolist() == [list(x) for x in zip(left, right, strict=True)]
    assert isinstance(flac.decode_all([stream[:-1] + bytes([stream[-1] ^ 1])])[0], flac.Damaged)


def test_media_rows(spark, sf):
    texts = [None, "", "x" * 100_000, "straße", "straße", "y"]
    docs = spark.createDataFrame([(k or None, t, "own", 7) for k, t in zip((1, 2, 3, 4, 4, 0), texts, strict=True)], "doc_id long, text string, media string, n_bytes int")
    stored = media.to_flac(docs)
    coded = [bytes(r.media) for r in stored.collect()]
    rows = media.probe(stored, 1000).collect()
    for r, text, stream in zip(rows, texts, coded, strict=True):
        data = (text or "").encode()
        n = len(data)
        data += b" " * (-n % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(data), hashlib.sha256(data).hexdigest())
        assert (r.media_bytes, r.media_sha256, r.tail_crc32) == (len(stream), hashlib.sha256(stream).hexdigest(), zlib.crc32(data[-16:]))
        x = [b - 128 for b in data]
        changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r.feature == f"peak={max(map(abs, x))};mean={sum(x) * 1000 // len(x)};ms={sum(v * v for v in x) * 1000 // len(x)};crossings={changes}"
        pcm = [b"".join(v.to_bytes(2, "little", signed=True) for v in x[at : at + 1000]) for at in range(0, len(x), 1000)]
        assert [tuple(b) for b in r.pcm_blocks] == [(1000 * k, len(p) // 2, zlib.crc32(p)) for k, p in enumerate(pcm)]
    assert rows[3][1:] == rows[4][1:]
    blocks = media.pcm_blocks(stored.where("doc_id = 3"), 1000).collect()
    assert [(b.first_sample, b.n_samples, zlib.crc32(b.pcm)) for b in blocks] == [tuple(b) for b in rows[2].pcm_blocks]
    bad = spark.createDataFrame([(1, None), (2, b"fLaC"), (3, b"no")], "doc_id long, media binary")
    assert all(r.error and r.pcm is None for r in media.pcm_blocks(bad).collect())
    assert media.probe(media.to_flac(docs.limit(0))).count() == 0
    whole = media.query(spark, sf)
    assert whole.count() == whole.where("payload_bytes = greatest(192, ceil(n_bytes / 192) * 192) and size(pcm_blocks) > 0").count()


def test_blocks_one_after_another(spark, sf, monkeypatch):
    """A benchmark in many blocks: the same result, and one Python step at a time."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(repr, decontaminate.leaks(docs, bench).drop("text").collect()))
    total = bench.selectExpr("sum(length(cast(text as binary)) + 1)").first()[0]
    monkeypatch.setattr(decontaminate, "BLOCK", -(-total // 40))
    assert len(list(decontaminate.blocks(bench, 10))) == 10
    out = decontaminate.leaks(docs, bench)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(repr, out.drop("text").collect())) == whole
