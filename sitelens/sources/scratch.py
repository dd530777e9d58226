"""Written intermediate tables: lineage ends in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder, which goes with the process, only where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    return f"{root}/{what}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    found = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, found, True)
    return found


def materialize(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
