"""What the operators share: reading tables, scratch tables that survive lost executors, connected classes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set on one machine, where it goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(scratch_dir, "own", None)
        if not found:
            found = scratch_dir.own = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, found, True)
    return found


_written: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The tables that are written inside, in order; those of other threads and of runs around or beside are not among them."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)


def written() -> list[str]:
    """The tables that this process has written and not dropped, in order."""
    return list(_written)


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)
        if (mine := _scope.get()) and path in mine:
            mine.remove(path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends in replicated files, not in executors' memory."""
    path = f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    if (mine := _scope.get()) is not None:
        mine.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (Spark's names know no case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, together its identity."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(0x5EED), text).alias("k2")]


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star contraction. Minima are combined before the shuffle, hubs come back through
    ordinary joins that adaptive execution may split, and each round ends in a written table. Nodes without edges get no row.
    Loops are allowed, repeated edges too; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    e = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s"))
        e = materialize(small.select("s.*").where("a <> b").distinct(), "stars")
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = tuple(row)
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("b"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
