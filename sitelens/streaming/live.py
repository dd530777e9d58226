"""Streams: counters kept up to date from files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.scratch import scratch_path


def event_counts(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """Events per type and day of all files there now, from a stream whose state holds one row per type and day.

    Each run takes what is there (available-now trigger) and ends; the stream's checkpoint is in the shared folder."""
    path = scratch_path(spark, "event-counts")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", pattern).parquet(folder)
    counts = stream.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts")

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_type string, day string, n long").parquet(f"{path}/counts")
