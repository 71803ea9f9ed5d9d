"""Work on many groups at once: groups stay whole, labels and bridges equal those of one group at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacut.operators import batches, components, compose, export, vector


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_stay_whole(size):
    rows = pd.DataFrame({"a": np.repeat([1, 1, 2, 3], [2, 9, 1, 4]), "b": np.repeat([1, 2, 2, 2], [2, 9, 1, 4]), "v": range(16)})
    parts = [rows.iloc[k : k + size] for k in range(0, len(rows), size)]
    got = list(batches.whole_groups(iter(parts), ["a", "b"], 3))
    assert pd.concat(got)["v"].tolist() == list(range(16))
    seen = [set(zip(p["a"], p["b"], strict=True)) for p in got]
    assert sum(map(len, seen)) == 4


def flooded(cells):
    """Least (y, x) of each cell's 4-connected component."""
    out = {}
    for start in sorted(cells):
        if start in out:
            continue
        todo = [start]
        while todo:
            c = todo.pop()
            if c in cells and c not in out:
                out[c] = start
                todo += [(c[0] + a, c[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    return out


def test_many_layers_labelled_in_few_calls(spark):
    """A call a layer is what took the time: 600 layers must go through far fewer calls of Python."""
    rng = np.random.default_rng(5)
    masks = {(i, k): {(y, x) for y in range(9) for x in range(11) if rng.random() < 0.6} for i in range(300) for k in range(2)}
    spans = []
    for (i, k), cells in masks.items():
        for y, x in sorted(cells):
            if (y, x - 1) not in cells:
                end = x
                while (y, end + 1) in cells:
                    end += 1
                spans.append((i, k, y, x, end))
    df = spark.createDataFrame(spans, "image_id long, layer_id int, y int, x0 int, x1 int")
    images = df.select("image_id").distinct().select("image_id", F.lit(11).alias("width"), F.lit(9).alias("height"))
    for strip in (512, 4):
        got = components.label(df, images, strip).collect()
        assert len(got) == len(spans)
        expect = {key: flooded(cells) for key, cells in masks.items()}
        assert all(divmod(r.comp_id, 11) == expect[r.image_id, r.layer_id][r.y, r.x0] for r in got)
    calls = spark.sparkContext.accumulator(0)

    def counted(rows):
        calls.add(1)
        return rows

    batches.by_groups(df, ["image_id", "layer_id"], ["y"], counted, df.schema).count()
    assert 0 < calls.value <= 16


def octagon(doc, contour, cx, cy, r):
    a = np.arange(8) * np.pi / 4
    return [(doc, contour, k, float(cx + r * np.cos(v)), float(cy + r * np.sin(v))) for k, v in enumerate(a)]


def test_crowded_documents(spark):
    """Crossings and shortest clear bridges of contours that lie over each other, against all pairs."""
    rng = np.random.default_rng(6)
    rows = [r for doc in (1, 2) for c in range(60) for r in octagon(doc, c, *rng.integers(0, 300, 2), 90 if c == 0 else rng.integers(4, 15))]
    df = spark.createDataFrame(rows, vector.VERTICES)
    walls = vector.edges(df).selectExpr("doc_id", "contour_id as _c", "x as wx", "y as wy", "nx as vx", "ny as vy")
    found = vector.candidates(df)
    cut = vector.cross(tuple(map(F.col, ("x", "y", "fx", "fy"))), tuple(map(F.col, ("wx", "wy", "vx", "vy"))), 1e-4)
    key = ["doc_id", "contour_id", "seq", "edge"]
    hit = found.join(walls, "doc_id").where((F.col("_c") != F.col("contour_id")) & (F.col("_c") != F.col("mainland")) & cut).select(*key).distinct()
    expect = vector.shortest(found.join(hit, key, "left_anti")).select(*key).collect()
    assert sorted(vector.shortest_clear(df).select(*key).collect()) == sorted(expect)
    assert 0 < len(expect) < 118
    own = lambda k: vector.edges(df).select("doc_id", F.col("contour_id").alias(f"c{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("x", "y", "nx", "ny")))
    met = own(1).join(own(2), "doc_id").where((F.col("c1") < F.col("c2")) & vector.cross(*(tuple(F.col(f"{c}{k}") for c in ("x", "y", "nx", "ny")) for k in (1, 2)), 0.01))
    plan = vector.crossings(df, 0.01)
    assert sorted(plan.collect()) == sorted(met.groupBy("doc_id", "c1", "c2").count().collect())


def test_marks_without_repeats(spark):
    """Marks of canvases of odd, tiny and long shapes, without repeats though nothing but the mask is made distinct."""
    sizes = {1: (1, 1), 2: (8, 8), 3: (3, 40), 4: (41, 6)}
    images = spark.createDataFrame([(i, w, h) for i, (w, h) in sizes.items()], "image_id long, width int, height int")
    mask = spark.createDataFrame([(i, 0, x, y) for i, (w, h) in sizes.items() for x in range(w) for y in range(h) if (x + y) % 3 == 0] + [(1, 0, 0, 0)], "image_id long, layer_id int, x int, y int")
    got = [tuple(r) for r in export.with_raster_marks(mask, images).collect()]
    expect = set()
    for r in mask.collect():
        expect.add((r.image_id, 0, r.x + 24, r.y + 24))
    for i, (w, h) in sizes.items():
        for cx in (12, w + 36):
            for cy in (12, h + 36):
                for d in range(-14, 15):
                    for t in (-1, 0, 1):
                        expect |= {(i, 0, x, y) for x, y in ((cx + d, cy + t), (cx + t, cy + d)) if 0 <= x < w + 48 and 0 <= y < h + 48}
    assert len(got) == len(set(got)) and set(got) == expect
    made = export.with_raster_marks(mask, images)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Aggregate [") == 2  # of the mask and of its layers, not of the marks


def test_composite_by_hash(spark):
    masks = spark.createDataFrame([(1, k, x, 0) for k in range(3) for x in range(k, 4)], "image_id long, layer_id int, x int, y int")
    layers = spark.createDataFrame([(1, 0, 2, "#a", True), (1, 1, 0, "#b", True), (1, 2, 5, "#c", False)], "image_id long, layer_id int, paint_order int, color string, visible boolean")
    found = compose.composite(masks, layers)
    assert sorted(map(tuple, found.collect())) == [(1, x, 0, "#a") for x in range(4)]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_saved_tables_are_not_sent_to_all(spark):
    saved = components._saved(spark.range(2000).selectExpr("id as image_id", "1 as layer_id"))
    joined = saved.join(spark.range(500_000).selectExpr("id as image_id"), "image_id").join(components._saved(saved), ["image_id", "layer_id"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in spark.range(9).selectExpr("id as image_id").join(F.broadcast(saved), "image_id")._jdf.queryExecution().executedPlan().toString()


def all_pairs(df, margin=0.01):
    own = lambda k: vector.edges(df).select("doc_id", F.col("contour_id").alias(f"c{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("x", "y", "nx", "ny")))
    met = own(1).join(own(2), "doc_id").where((F.col("c1") < F.col("c2")) & vector.cross(*(tuple(F.col(f"{c}{k}") for c in ("x", "y", "nx", "ny")) for k in (1, 2)), margin))
    return sorted(map(tuple, met.groupBy("doc_id", "c1", "c2").count().collect()))


@pytest.mark.parametrize(("few", "block"), [(32, 2000), (32, 7), (7, 2000), (4, 2000)])
def test_crossings_of_contours_and_of_edges(spark, few, block):
    """Pairs of small contours, of large ones and of both, in cells of one block and of many; odd rings and null keys."""
    rng = np.random.default_rng(7)
    rows = [r for doc in (1, 2) for c in range(50) for r in octagon(doc, c, *rng.integers(0, 120, 2), 90 if c == 0 else rng.integers(4, 15))]
    rows += [(1, 60 + c, s, float(rng.integers(0, 120)), float(rng.integers(0, 120))) for c in range(12) for s in range(1 + c // 2)]  # of one vertex to six
    rows += [(3, 1, 0, 5.0, 5.0), (3, 2, 0, 5.0, 5.0)]
    df = spark.createDataFrame([*rows, (None, 1, 0, 1.0, 1.0), (1, None, 0, 1.0, 1.0)], vector.VERTICES)
    expect = all_pairs(spark.createDataFrame(rows, vector.VERTICES))
    assert sorted(map(tuple, vector.crossings(df, 0.01, few, block).collect())) == expect and len(expect) > 200
    assert vector.crossings(df.limit(0), 0.01).count() == 0


def test_pairs_that_cross_are_not_shuffled(spark):
    """Pairs of contours are far more than contours; none is dealt out after it is found."""
    df = spark.createDataFrame([r for c in range(40) for r in octagon(1, c, 50 + c, 50, 9)], vector.VERTICES)
    plan = vector.crossings(df, 0.01)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInPandas")] and "Join" not in plan[: plan.index("MapInPandas")]
