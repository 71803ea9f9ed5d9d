import struct
import zlib

import numpy as np
import pytest

from stratacut.sources import png


def filtered(raw, bpp, kind):
    """Rows of bytes with one filter applied, or all five in turn."""
    out, before = b"", np.zeros(raw.shape[1], int)
    for y, row in enumerate(raw.astype(int)):
        k = y % 5 if kind is None else kind
        left = np.r_[np.zeros(bpp, int), row[:-bpp]]
        corner = np.r_[np.zeros(bpp, int), before[:-bpp]]
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        out += bytes([k]) + ((row - [0 * left, left, before, (left + before) // 2, near][k]) % 256).astype(np.uint8).tobytes()
        before = row
    return out


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def file(width, height, depth, colour, rows, more=b"", interlaced=0):
    packed = zlib.compress(rows)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + more + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, None])
def test_filters_and_colour_types(kind):
    rng = np.random.default_rng(1)
    for colour, n in png.CHANNELS.items():
        raw = rng.integers(0, 256, (11, 7, n), dtype=np.uint8)
        colours = rng.integers(0, 256, (256, 3), dtype=np.uint8)
        out = png.decode(file(7, 11, 8, colour, filtered(raw.reshape(11, -1), n, kind), chunk(b"PLTE", colours.tobytes()) + chunk(b"tRNS", bytes(range(256))) if colour == 3 else b""))
        if colour == 3:
            assert (out[..., :3] == colours[raw[..., 0]]).all() and (out[..., 3] == raw[..., 0]).all()
        else:
            assert (out[..., :3] == (raw[..., :3] if n >= 3 else raw[..., :1])).all()
            assert (out[..., 3] == (raw[..., -1] if n in (2, 4) else 255)).all()
        deep = rng.integers(0, 256, (11, 7, n, 2), dtype=np.uint8)
        if colour != 3:
            assert (png.decode(file(7, 11, 16, colour, filtered(deep.reshape(11, -1), 2 * n, kind)))[..., 0] == deep[:, :, 0, 0]).all()


def test_small_depths_and_damage():
    bits = np.random.default_rng(2).integers(0, 2, (5, 13), dtype=np.uint8)
    assert (png.decode(file(13, 5, 1, 0, filtered(np.packbits(bits, axis=1), 1, None)))[..., 1] == bits * 255).all()
    good = file(4, 4, 8, 2, filtered(np.zeros((4, 12), np.uint8), 3, 0), chunk(b"tRNS", bytes(6)))
    assert (png.decode(good)[..., 3] == 0).all()
    for bad in (b"", b"GIF89a", good[:-20], good[:40] + b"x" + good[41:], file(4, 4, 8, 2, b"\x00" * 20), file(4, 4, 8, 2, b"\x07" * 52), file(4, 4, 8, 2, b"\x00" * 52, interlaced=1), file(4, 4, 8, 3, filtered(np.zeros((4, 4), np.uint8), 1, 0))):
        with pytest.raises((ValueError, struct.error)):
            png.decode(bad)


def test_source_and_sink(spark, tmp_path):
    rng = np.random.default_rng(3)
    raw = {f"p{k}.png": rng.integers(0, 256, (6 + k, 5, 4), dtype=np.uint8) for k in range(7)}
    made = spark.createDataFrame([(n, bytearray(file(5, len(r), 8, 6, filtered(r.reshape(len(r), -1), 4, None)))) for n, r in raw.items()] + [("bad.png", bytearray(b"no"))], "name string, png binary")
    assert png.save_pngs(made, f"{tmp_path}/in") == png.save_pngs(made.repartition(3), f"{tmp_path}/in") == 8
    (tmp_path / "in" / "note.txt").write_text("x")
    read = png.read_pngs(spark, f"{tmp_path}/in", partitionBytes=3 << 20)
    assert read.rdd.getNumPartitions() == 3
    rows = read.collect()
    got = {(r.path.rsplit("/", 1)[1], r.x, r.y): (r.r, r.g, r.b, r.a) for r in rows if r.error is None}
    assert got == {(n, x, y): tuple(int(v) for v in m[y, x]) for n, m in raw.items() for y in range(len(m)) for x in range(5)}
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["bad.png"]
    ours = sorted((r.path.rsplit("/", 1)[1], r.width, r.height) for r in read.where("x = 0 and y = 0").collect())
    theirs = spark.read.format("image").option("dropInvalid", True).load(f"{tmp_path}/in/*.png").select("image.origin", "image.width", "image.height").collect()
    assert ours == sorted((r.origin.rsplit("/", 1)[1], r.width, r.height) for r in theirs)


def test_small_files_share_batches_and_tasks(tmp_path):
    rgba = np.arange(4 * 6, dtype=np.uint8).reshape(2, 3, 4)
    lines = b"".join(b"\0" + row.tobytes() for row in rgba)
    for k in range(300):
        (tmp_path / f"{k:03}.png").write_bytes(png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    assert len(png.PngReader(f"file://{tmp_path}", 1 << 20).partitions()) <= 64
    reader = png.PngReader(f"file://{tmp_path}", 301 << 20)
    parts = reader.partitions()
    assert len(parts) == 1
    (batch,) = reader.read(parts[0])
    rows = batch.to_pylist()
    assert len(rows) == 1800 and [(r["x"], r["y"], r["r"], r["a"]) for r in rows[6:12]] == [(k % 3, k // 3, 4 * k, 4 * k + 3) for k in range(6)]
    assert rows[6]["path"].endswith("001.png") and rows[0]["width"] == 3 and rows[0]["height"] == 2
