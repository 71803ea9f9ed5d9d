"""Small pictures in batches: the same results as by strips and cells, in few jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacut.operators import bridges, components, neighborhood, small

MIXED = 150  # between the sizes of the pictures below


def pictures(spark):
    """Three layers of noise on pictures of several sizes, with a cover, and dense pixels of them."""
    rng = np.random.default_rng(11)
    sizes = {k: (int(rng.integers(1, 19)), int(rng.integers(1, 17))) for k in range(12)}
    ink = [(k, layer, x, y) for k, (w, h) in sizes.items() for layer in range(3) for x in range(w) for y in range(h) if rng.random() < (0.75, 0.5, 0.9)[layer]]
    over = [(k, x, y) for k, (w, h) in sizes.items() for x in range(w) for y in range(h) if rng.random() < 0.5]
    dense = [(k, x, y, int(rng.integers(0, 256))) for k, (w, h) in sizes.items() for x in range(w) for y in range(h)]
    images = spark.createDataFrame([(k, w, h) for k, (w, h) in sizes.items()], "image_id long, width int, height int")
    assert {w * h > MIXED for w, h in sizes.values()} == {True, False}
    return spark.createDataFrame(ink, "image_id long, layer_id int, x int, y int"), images, spark.createDataFrame(over, "image_id long, x int, y int"), spark.createDataFrame(dense, "image_id long, x int, y int, luma int")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


WAYS = {
    "clean": lambda mask, images, over, dense: components.clean(mask, images, 3),
    "blur": lambda mask, images, over, dense: neighborhood.blur(dense, 2.5),
    "all": lambda mask, images, over, dense: bridges.covered_candidates(mask, images, over, bridges=3, each=4, least=2),
    "near": lambda mask, images, over, dense: bridges.candidates(mask, images, bridges=4, each=3, within=4, opposing=True),
    "shore": lambda mask, images, over, dense: bridges.candidates(mask, images, each=8, mainland_only=True, single=F.col("layer_id") != 1),
    "smart": lambda mask, images, over, dense: bridges.smart_bridges(mask, images, over, 2, each=8)[1],
    "erased": lambda mask, images, over, dense: bridges.smart_bridges(mask, images, over, 3, each=8)[0],
    "stack": lambda mask, images, over, dense: bridges.bridge_stack(mask, images, [0, 2, 1])[1],
    "cut": lambda mask, images, over, dense: bridges.bridge_stack(mask, images, [2, 0, 1])[0],
}


@pytest.mark.parametrize("way", WAYS)
def test_as_by_strips_and_cells(spark, monkeypatch, way):
    given = pictures(spark)
    few = rows(WAYS[way](*given))
    for area in (0, MIXED):
        monkeypatch.setattr(small, "AREA", area)
        assert rows(WAYS[way](*given)) == few
    assert len(few) > 50


def test_a_stack_of_small_pictures_takes_few_jobs(spark):
    mask, images, _, _ = pictures(spark)
    spark.sparkContext.setJobGroup("stack", "stack")
    done, listed = bridges.bridge_stack(mask, images, [0, 1, 2])
    assert done.count() and listed.count()
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("stack")) <= 25
