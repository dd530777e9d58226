"""Exact dedup over an extendible-hash index on shared files, in column expressions only.

Each text's 64-bit hash is its key. Keys with the number of their rows and the row that would stay are the index's records; a record
lies in the bucket that the directory names for the leading bits of its key. The directory starts near the depth that the number of
keys asks for and doubles (one more bit) while a bucket holds more than ``capacity`` keys; buddies that fit into one bucket share it,
so a bucket has the depth at which it last had to split. Only counts of buckets are kept in the directory. Records are written to
shared files in order of buckets.

Keys with several rows are then proved: owner tasks take ranges of keys (whole buckets), chain the texts of each key and compare
their bytes. Keys of over ``hot`` rows combine equal texts before the shuffle, so a text that a third of all rows hold sends one row
a task. A key whose chain holds several texts is a collision: its rows are grouped by their bytes, not by the key.

Defined results: null text is empty; of equal texts the row with the largest doc_id stays, a null doc_id is the smallest, of equal
doc_ids one row stays (the others have kept false and the same keep_id); keep_id is null only where a group has no doc_id; empty tables
give no rows; other columns, whatever their names, are ignored; texts of any length are hashed and compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY, HOT, DEEPEST = 4096, 1024, 24
#: Records of this size are broadcast only while they are fewer than BROADCAST bytes in all.
RECORD, BROADCAST = 32, 64 << 20


def directory(keys: DataFrame, capacity: int = CAPACITY, deepest: int = DEEPEST) -> tuple[DataFrame, int]:
    """(cell, depth, bucket) for every used cell of a directory over keys(key long, distinct), and its depth in bits.

    A bucket is named by its first cell. Beyond ``deepest`` bits (keys that share so many) a bucket overflows; nothing depends on it."""
    depth = min(deepest, max(1, math.ceil(math.log2(max(keys.count(), 1) / capacity))))
    while True:
        cells = materialize(keys.groupBy(_cell(depth).alias("cell")).agg(F.count("*").alias("n")), "cells")
        if depth == deepest or cells.where(F.col("n") > capacity).isEmpty():
            break
        depth += 1  # the directory doubles
    nodes = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("first", F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - depth), {depth} - depth)"))
    fits = nodes.groupBy("depth", "first").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == depth)).select("depth", "first")
    least = nodes.join(fits, ["depth", "first"]).groupBy("cell").agg(F.min(F.struct("depth", "first")).alias("b"))
    return least.select("cell", "b.depth", F.col("b.first").alias("bucket")), depth


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Records (key, n, best, bucket, depth, owner) of entries(key, doc_id, row): the rows of each key and the one that would stay."""
    spark = entries.sparkSession
    records = entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))
    records = materialize(records, "records")
    cells, bits = directory(records.select("key"), capacity)
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # an owner's range: as many of the directory's cells as another's, in order
    owner = F.least(F.floor(F.col("bucket") * F.lit(owners) / F.lit(2**bits)), F.lit(owners - 1)).cast("int")
    placed = records.withColumn("cell", _cell(bits)).join(cells, "cell").withColumn("owner", owner).drop("cell")
    return materialize(placed.repartitionById(owners, "owner").sortWithinPartitions("bucket", "key"), "index")


def exact_copies(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY, hot: int = HOT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", hash_of(F.col("text")).cast("long"))
    entries = materialize(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "entries")
    shared = materialize(build_index(entries, capacity).where("n > 1"), "shared")
    clash = collisions(read.select("key", "text"), shared, hot)
    some = not clash.isEmpty()
    known = small(shared.select("key", "n", "best"))
    plain = entries.join(clash, "key", "left_anti") if some else entries
    out = plain.join(known, "key", "left").select(*_result(F.lower(F.hex("sha"))))
    if not some:
        return out
    rows = materialize(read.join(clash, "key").withColumn("row", F.monotonically_increasing_id()), "collided")
    groups = rows.groupBy("key", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))
    return out.unionByName(rows.join(groups, ["key", "text"]).select(*_result(F.sha2("text", 256))))


def small(records: DataFrame) -> DataFrame:
    """A hint to broadcast records while they are known to be few."""
    return F.broadcast(records) if records.count() * RECORD <= BROADCAST else records


def collisions(texts: DataFrame, shared: DataFrame, hot: int = HOT) -> DataFrame:
    """Keys of shared(key, n, owner) under which texts(key, text) hold more than one text, by comparison of all bytes."""
    owners = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = texts.join(small(shared.select("key", "owner", (F.col("n") > hot).alias("hot"))), "key")
    # owner tasks: whole key ranges, no further shuffle
    chains = held.where(~F.col("hot")).repartitionById(owners, "owner").groupBy("owner", "key", "text").agg(F.count("*").alias("copies"))
    found = chains.groupBy("owner", "key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
    if not shared.where(F.col("n") > hot).isEmpty():
        many = held.where("hot").groupBy("key", "text").agg(F.count("*").alias("copies"))
        found = found.unionByName(many.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"))
    return materialize(found, "collisions")


def _result(sha: Column) -> list[Column]:
    return [
        F.col("doc_id"),
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        sha.alias("text_sha256"),
    ]


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
