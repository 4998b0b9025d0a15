"""Spatial tables derived from the star schema, in integer micro-degrees so that every engine computes the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS_SQL = """
fx_assets as (
  select id, k, x - hw as minx, x + hw as maxx, y - hh as miny, y + hh as maxy, x, y, -118.15::double + x / 1e6::double as lon, 34.18::double + y / 1e6::double as lat, asset_type, acctbal, nation
  from (select 'a' || c_custkey as id, c_custkey as k, (c_custkey % 40) * 200 + (c_custkey * 7919) % 61 as x, floor(c_custkey / 40.0)::bigint * 200 + (c_custkey * 104729) % 67 as y,
        60 + (c_custkey * 31) % 70 as hw, 60 + (c_custkey * 37) % 70 as hh, c_mktsegment as asset_type, c_acctbal as acctbal, c_nationkey as nation from customer))"""
IMAGES_SQL = """
fx_images as (
  select event_id, (event_id * 6007) % 8000 as px, (event_id * 5003) % 7600 as py, -118.15::double + ((event_id * 6007) % 8000) / 1e6::double as plon, 34.18::double + ((event_id * 5003) % 7600) / 1e6::double as plat,
         (event_id * 97) % 360 as heading, cast(ts as date) as capture_date, user_id as creator, event_type, props from events)"""
DETECTIONS_SQL = """
fx_detections as (
  select 2 * k as did, minx, miny, maxx, maxy from fx_assets
  union all select 2 * k + 1, minx + 10 + k % 20, miny + 5 + k % 11, maxx + 10 + k % 20, maxy + 5 + k % 11 from fx_assets where k % 3 = 0)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k % 40) * 200 + (k * 7919) % 61, F.floor(k / 40) * 200 + (k * 104729) % 67
    hw, hh = 60 + (k * 31) % 70, 60 + (k * 37) % 70
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("a"), k.cast("string")).alias("id"), k.alias("k"), (x - hw).alias("minx"), (x + hw).alias("maxx"), (y - hh).alias("miny"), (y + hh).alias("maxy"), x.alias("x"), y.alias("y"),
        (F.lit(-118.15) + x / F.lit(1e6)).alias("lon"), (F.lit(34.18) + y / F.lit(1e6)).alias("lat"), F.col("c_mktsegment").alias("asset_type"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    px, py = (e * 6007) % 8000, (e * 5003) % 7600
    return read(spark, sf_dir, "events").select(
        e, px.alias("px"), py.alias("py"), (F.lit(-118.15) + px / F.lit(1e6)).alias("plon"), (F.lit(34.18) + py / F.lit(1e6)).alias("plat"), ((e * 97) % 360).alias("heading"),
        F.col("ts").cast("date").alias("capture_date"), F.col("user_id").alias("creator"), "event_type", "props",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir)
    dx, dy = 10 + F.col("k") % 20, 5 + F.col("k") % 11
    shifted = a.where("k % 3 = 0").select((2 * F.col("k") + 1).alias("did"), (F.col("minx") + dx).alias("minx"), (F.col("miny") + dy).alias("miny"), (F.col("maxx") + dx).alias("maxx"), (F.col("maxy") + dy).alias("maxy"))
    return a.select((2 * F.col("k")).alias("did"), "minx", "miny", "maxx", "maxy").unionByName(shifted)


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets as the collection schema: id, ord, box, attrs. k % 4 = 0 has its type under `category`; k % 7 = 0 no balance; k % 11 = 0 the nation as text; k % 13 = 0 no attributes."""
    a = assets(spark, sf_dir)
    pair = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("variant").alias("value"))
    none = F.lit(None).cast("struct<key:string,value:variant>")
    pairs = F.array(
        F.when(F.col("k") % 4 != 0, pair("asset_type", F.col("asset_type"))).otherwise(pair("category", F.col("asset_type"))), F.when(F.col("k") % 7 != 0, pair("acctbal", F.col("acctbal"))).otherwise(none),
        F.when(F.col("k") % 11 == 0, pair("nation", F.col("nation").cast("string"))).otherwise(pair("nation", F.col("nation"))),
    )
    attrs = F.map_from_entries(F.when(F.col("k") % 13 == 0, F.array().cast("array<struct<key:string,value:variant>>")).otherwise(F.filter(pairs, lambda p: p.isNotNull())))
    return a.select("id", F.col("k").alias("ord"), "k", "minx", "miny", "maxx", "maxy", attrs.alias("attrs"))


ATTRS_SQL = """
fx_attrs as (
  select id, k, minx, miny, maxx, maxy, case when k % 13 <> 0 and k % 4 <> 0 then asset_type end as aty, case when k % 13 <> 0 and k % 4 = 0 then asset_type end as cat,
         case when k % 13 <> 0 and k % 7 <> 0 then acctbal end as acctbal, case when k % 13 <> 0 and k % 11 <> 0 then nation end as nation_n, case when k % 13 <> 0 and k % 11 = 0 then nation::varchar end as nation_s from fx_assets)"""
