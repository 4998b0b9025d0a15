"""Every registered spatial query against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from parcelflow.plans import catalog


#: Their nested loop joins a table with one row that an aggregation gives.
ONE_ROW = {"key3_slice_backwards", "key5_put", "key6_set1_add", "jn1_merge_skip", "jn1_merge_overwrite", "jn2_merge_images", "snk7_mosaic_offsets"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def cell(v):
    return round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    rel = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in ONE_ROW or ("NestedLoop" not in plan and "CartesianProduct" not in plan)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_flagship_reads_little(spark, sf):
    df = catalog.QUERIES["udf12_win2_win3_localise"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("LogicalRDD") <= 6


def test_box_filter_reaches_the_scan(spark, sf, tmp_path):
    from parcelflow.functions import boxes
    from parcelflow.operators import collection
    from parcelflow.plans import fixtures

    fixtures.assets(spark, sf).write.parquet(str(tmp_path / "a"))
    df = collection.filter_by_box(spark.read.parquet(str(tmp_path / "a")), boxes.literal(0, 0, 500, 500)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "LessThanOrEqual(minx,500)" in plan and "acctbal" not in plan
