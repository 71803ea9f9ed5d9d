"""Every registered query against its SQL, and invariants where there is none."""

import os

import duckdb
import pytest

from stratacut.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, expect = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expect.columns)
    rows = [df[columns].astype(str).sort_values(columns).reset_index(drop=True) for df in (got, expect)]
    assert rows[0].equals(rows[1])


def test_bridges(spark):
    q = queries.queries()
    listed = q["b09_b16_choice"](spark, SF).toPandas()
    chosen = listed[listed.selected]
    assert (chosen.groupby(["image_id", "island", "sector"]).size() == 1).all()
    stats = q["b14_statistics"](spark, SF).toPandas()
    assert stats.bridges_created.sum() == len(chosen)
    ink = q["t02_layer_masks"](spark, SF).where("layer_id < 2").groupBy("image_id", "layer_id").count().toPandas().set_index(["image_id", "layer_id"])["count"]
    left = q["b10_erased"](spark, SF).toPandas().set_index(["image_id", "layer_id"])["ink"]
    assert left.index.sort_values().equals(ink.index.sort_values())
    assert (left <= ink).all() and left.sum() < ink.sum()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["image_id", "color", "n_pixels"]
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
