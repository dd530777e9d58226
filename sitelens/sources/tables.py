"""Sites and map features derived from the given tables, and the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _degrees(key: str, factor: int, span: int, start: float) -> Column:
    return F.lit(start) + (F.col(key) * factor % span).cast("double") / F.lit(float(span))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, name (empty for some), tags for its holes and kind, lon, lat and for every third site a box (west, south, east, north)."""
    key = F.col("s_suppkey")
    named = F.when(key % 17 == 0, " ").otherwise(F.col("s_name"))
    holes = F.when(key % 11 == 0, "9").when(key % 11 == 1, "18.0").when(key % 11 == 2, "many")
    kind = F.when(key % 13 == 0, "links; par_3")
    s = table(spark, sf_dir, "supplier").select(key.alias("site"), named.alias("name"), holes.alias("holes"), kind.alias("golf"), _degrees("s_suppkey", 7919, 1000, -9.5).alias("lon"), _degrees("s_suppkey", 104729, 1000, 38.0).alias("lat"))
    boxed = F.col("site") % 3 == 0
    return s.withColumns({k: F.when(boxed, F.col(c) + F.lit(d)) for k, c, d in (("west", "lon", -0.02), ("south", "lat", -0.02), ("east", "lon", 0.02), ("north", "lat", 0.02))})


#: Tag of a feature by its key's remainder.
TAGS = ["green", "fairway", "tee", "bunker", "pin", "hole", "rough", "cartpath", "driving_range", "practice", "green;fairway", "lateral_water_hazard"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feat, lon, lat, golf (a tag), way (whether it is a way rather than a node)."""
    tags = F.array(*[F.lit(t) for t in TAGS])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("feat"),
        _degrees("o_orderkey", 15485863, 1000000, -9.5).alias("lon"),
        _degrees("o_orderkey", 32452843, 1000000, 38.0).alias("lat"),
        F.element_at(tags, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("golf"),
        (F.col("o_orderkey") % 5 != 0).alias("way"),
    )


SITES_SQL = """sites AS (SELECT s_suppkey AS site, CASE WHEN s_suppkey % 17 = 0 THEN ' ' ELSE s_name END AS name,
  CASE s_suppkey % 11 WHEN 0 THEN '9' WHEN 1 THEN '18.0' WHEN 2 THEN 'many' END AS holes, CASE WHEN s_suppkey % 13 = 0 THEN 'links; par_3' END AS kind, CAST(-9.5 AS DOUBLE) + CAST(s_suppkey * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
  CAST(38 AS DOUBLE) + CAST(s_suppkey * 104729 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat FROM supplier),
boxes AS (SELECT *, site % 3 = 0 AS boxed FROM sites)"""
FEATURES_SQL = """feats AS (SELECT o_orderkey AS feat, CAST(-9.5 AS DOUBLE) + CAST(o_orderkey * 15485863 % 1000000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
  CAST(38 AS DOUBLE) + CAST(o_orderkey * 32452843 % 1000000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat,
  ['green','fairway','tee','bunker','pin','hole','rough','cartpath','driving_range','practice','green;fairway','lateral_water_hazard'][o_orderkey % 12 + 1] AS golf, o_orderkey % 5 <> 0 AS way FROM orders)"""
