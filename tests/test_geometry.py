"""Joins, lines, rings and simplification by rounds against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacut.operators import bridges, export, nearest, vector


def walked(x1, y1, x2, y2):
    """Pixels of a line by its error term."""
    dx, dy = abs(x2 - x1), abs(y2 - y1)
    sx, sy, err, out = (1 if x1 < x2 else -1), (1 if y1 < y2 else -1), dx - dy, [(x1, y1)]
    while (x1, y1) != (x2, y2):
        twice = 2 * err
        if twice > -dy:
            err, x1 = err - dy, x1 + sx
        if twice < dx:
            err, y1 = err + dx, y1 + sy
        out.append((x1, y1))
    return out


def test_all_lines_within_forty_pixels(spark):
    ends = [(0, 20, 20, x, y) for x in range(41) for y in range(41)] + [(0, 40, 0, x, y) for x in range(41) for y in range(41)]
    got = {}
    df = bridges.line_pixels(spark.createDataFrame(ends, "image_id long, sx int, sy int, tx int, ty int"))
    assert "Python" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        got.setdefault((r.sx, r.sy, r.tx, r.ty), []).append((r.seq, r.x, r.y))
    assert len(got) == len({e[1:] for e in ends})
    for k, v in got.items():
        assert [p[1:] for p in sorted(v)] == walked(*k), k


def islands(n, side, seed):
    rng = np.random.default_rng(seed)
    cells = rng.permutation((side // 8) ** 2)[:n]
    return [(1, 0, k, 1 + k % 97, int(c % (side // 8)) * 8 + dx, int(c // (side // 8)) * 8 + dy) for k, c in enumerate(cells.tolist()) for dx, dy in ((1, 1), (3, 1), (1, 4))]


def frames(spark, points):
    sources = spark.createDataFrame([(a, b, k, s, x, y) for a, b, k, s, x, y in points], "image_id long, layer_id int, island long, area int, sx int, sy int")
    targets = spark.createDataFrame([(a, b, k, s, x, y, y * 4096 + x) for a, b, k, s, x, y in points], "image_id long, layer_id int, target long, t_area int, tx int, ty int, t_idx long")
    return sources, targets


def test_nearest_of_five_thousand_islands(spark):
    points = islands(5000, 1600, 1)
    sources, targets = frames(spark, points)
    other = F.col("target") != F.col("island")
    met = nearest.near_pairs(sources, targets, ["image_id", "layer_id"], 16)
    assert met.count() < 40 * len(points)  # nine cells hold some twenty points; all pairs would be 225 million
    got = {(r.island, r.sx, r.sy): (r.d2, r.t_idx) for r in nearest.nearest_join(sources, targets, ["image_id", "layer_id"], ["t_idx"], other).collect()}
    p = np.array([q[2:] for q in points])
    for k in range(0, len(p), 7):
        d2 = (p[:, 2] - p[k, 2]) ** 2 + (p[:, 3] - p[k, 3]) ** 2
        rest = [(int(d), int(q[3] * 4096 + q[2])) for d, q in zip(d2, p, strict=True) if q[0] != p[k, 0] and d <= 40_000]
        assert got[tuple(p[k, [0, 2, 3]].tolist())] == min(rest)
    larger = other & (F.col("t_area") > F.col("area"))
    close = nearest.nearest_of_each(sources, targets, ["image_id", "layer_id"], "target", ["t_idx"], larger, within=30).collect()
    found = {(r.island, r.sx, r.sy, r.target): r.d2 for r in close}
    assert len(found) == len(close) < 60 * len(points)
    for k in range(0, len(p), 501):
        expect = {}
        for q in p:
            d = int((q[2] - p[k, 2]) ** 2 + (q[3] - p[k, 3]) ** 2)
            if q[0] != p[k, 0] and q[1] > p[k, 1] and d <= 900:
                expect[int(q[0])] = min(d, expect.get(int(q[0]), d))
        assert {t: d for (i, x, y, t), d in found.items() if (i, x, y) == tuple(p[k, [0, 2, 3]].tolist())} == expect


def test_far_and_missing_targets(spark):
    sources, _ = frames(spark, [(1, 0, 1, 1, 0, 0), (2, 0, 1, 1, 5, 5), (3, 0, 1, 1, 2, 2), (1, 0, 1, 1, 900, 900)])
    _, targets = frames(spark, [(1, 0, 9, 9, 1000, 1000), (1, 0, 9, 9, 999, 1001), (2, 0, 9, 9, 5, 6), (2, 0, 9, 9, 6, 5)])
    got = nearest.nearest_join(sources, targets, ["image_id", "layer_id"], ["t_idx"]).collect()
    assert sorted((r.image_id, r.sx, r.tx, r.ty) for r in got) == [(1, 0, 1000, 1000), (1, 900, 1000, 1000), (2, 5, 6, 5)]
    assert nearest.nearest_join(sources.limit(0), targets, ["image_id", "layer_id"], ["t_idx"]).count() == 0
    each = nearest.nearest_of_each(sources, targets, ["image_id", "layer_id"], "target", ["t_idx"]).collect()
    assert sorted((r.image_id, r.sx, r.tx, r.ty) for r in each) == [(1, 0, 1000, 1000), (1, 900, 1000, 1000), (2, 5, 6, 5)]


def chained(cells):
    """Corners of all rings of a set of pixels, followed edge by edge."""
    starts = {}
    for x, y in cells:
        for (dx, dy), (ax, ay, bx, by) in (((0, -1), (0, 0, 1, 0)), ((1, 0), (1, 0, 1, 1)), ((0, 1), (1, 1, 0, 1)), ((-1, 0), (0, 1, 0, 0))):
            if (x + dx, y + dy) not in cells:
                starts.setdefault((x + ax, y + ay), []).append((x + bx, y + by))
    rings = []
    for first in sorted(starts, key=lambda p: (p[1], p[0])):
        while starts[first]:
            at, came, ring = first, (0, 0), []
            while True:
                options = sorted(starts[at])
                turn = [came[0] * (o[1] - at[1]) - came[1] * (o[0] - at[0]) for o in options]
                to = options[turn.index(max(turn))]
                starts[at].remove(to)
                step = (to[0] - at[0], to[1] - at[1])
                if step != came:
                    ring.append(at)
                at, came = to, step
                if at == first:
                    break
            rings.append(ring)
    return rings


def test_rings_equal_a_walk_along_the_edges(spark):
    rng = np.random.default_rng(2)
    masks = [{(x, y) for x in range(17) for y in range(13) if rng.random() < share} for share in (0.2, 0.5, 0.65, 0.9)]
    masks.append({(x, y) for x in range(90) for y in range(90) if (y % 4 == 0 and 0 < x < 89) or (x == 88 and y % 8 < 4) or (x == 1 and y % 8 >= 4)})  # a snake: one long ring
    mask = spark.createDataFrame([(k, 0, x, y) for k, m in enumerate(masks) for x, y in m], "image_id long, layer_id int, x int, y int")
    got = {}
    for r in export.outlines(mask).collect():
        got.setdefault(r.image_id, {}).setdefault(r.contour_id, []).append((r.seq, (int(r.x), int(r.y))))
    for k, m in enumerate(masks):
        rings = [[p for _, p in sorted(got[k][c])] for c in sorted(got[k])]
        assert rings == chained(m)
        assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in got[k].values())
    assert export.outlines(mask.limit(0)).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.8, 5.0])
def test_simplified_by_rounds(spark, tolerance):
    rng = np.random.default_rng(3)
    rings = {1: rng.random((150, 2)).cumsum(0) * 9, 2: rng.integers(0, 9, (40, 2)).astype(float), 3: np.array([[0.0, 0.0], [1, 0]]), 4: np.tile([[2.0, 3.0]], (7, 1))}
    rows = [(1, c, k, float(x), float(y)) for c, p in rings.items() for k, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, contour_id long, seq int, x double, y double")
    got = sorted(map(tuple, vector.simplify(df, tolerance, most=0).collect()))
    assert got == sorted(map(tuple, vector.simplify(df, tolerance).collect()))
    for c, p in rings.items():
        kept = p[vector.kept_points(p[:, 0], p[:, 1], tolerance)]
        assert [r[2:] for r in got if r[1] == c] == [(k, float(x), float(y)) for k, (x, y) in enumerate(kept)]


@pytest.mark.parametrize("most", [1, 120, 65_536])
def test_outlines_of_small_and_large_masks(spark, most):
    """Masks many at a time, by rounds, and some of each give the rings of a walk; rows without an image have none."""
    rng = np.random.default_rng(4)
    masks = {(i, k): {(x - 5, y - 3) for x in range(16) for y in range(12) if rng.random() < 0.1 + 0.2 * k} for i in range(6) for k in range(5)}
    masks[7, 0] = {(0, 0), (1, 1), (2, 0)}
    masks[8, 2] = {(4_000, 9), (1, 2)}
    rows = [(i, k, x, y) for (i, k), m in masks.items() for x, y in m]
    mask = spark.createDataFrame([*rows, (None, 0, 1, 1)], "image_id long, layer_id int, x int, y int")
    got = {}
    for r in export.outlines(mask, most).collect():
        got.setdefault((r.image_id, r.layer_id), {}).setdefault(r.contour_id, []).append((r.seq, (int(r.x), int(r.y))))
    assert got.keys() == {k for k, m in masks.items() if m}
    for k, rings in got.items():
        assert [[p for _, p in sorted(rings[c])] for c in sorted(rings)] == chained(masks[k])
        assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in rings.values())


def test_small_outlines_take_no_rounds(spark):
    mask = spark.range(3000).selectExpr("id as image_id", "0 as layer_id", "cast(id % 7 as int) x", "2 as y")
    plan = export.outlines(mask)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
