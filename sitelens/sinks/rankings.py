"""Rankings as CSV and JSON lines: parts written by Spark's committer, so readers see a whole table or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(ranking: DataFrame, path: str) -> None:
    ranking.write.mode("overwrite").option("header", True).csv(path)


def read_csv(like: DataFrame, path: str) -> DataFrame:
    """What write_csv wrote, with the types of like. Missing texts and empty ones are both NULL in CSV."""
    return like.sparkSession.read.schema(like.schema).option("header", True).csv(path)


def write_json(ranking: DataFrame, path: str) -> None:
    ranking.write.mode("overwrite").json(path)


def progress(ranking: DataFrame, tile: int, tiles: int) -> DataFrame:
    """One row on how far a ranking has come: partial or complete, sites, sites with 100 points."""
    status = "complete" if tile >= tiles else "partial"
    return ranking.agg(F.lit(status).alias("status"), F.lit(tile).alias("tile"), F.lit(tiles).alias("tiles"), F.count("*").alias("sites"), F.count_if(F.col("score") >= 100).alias("score_100"))
