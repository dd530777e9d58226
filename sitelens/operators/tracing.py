"""Rings out of directed edges: edges are paired at their ends, joined to chains block by block, chains to rings by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.sources.scratch import materialize

POINTS = "array<struct<x:bigint,y:bigint>>"
_POINT = pa.struct([("x", pa.int64()), ("y", pa.int64())])
#: Edges of one key that one task may join; a key with more is dealt to blocks by place.
AT_ONCE = 100_000


def points_column(lists: list[list[tuple[int, int]]]) -> pa.Array:
    """Lists of points as an Arrow column."""
    flat = np.array([c for points in lists for p in points for c in p], np.int64).reshape(-1, 2)
    ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(_POINT)))


def lists_of(column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """The points of each list of an Arrow column; a null point has null coordinates."""
    flat = column.flatten()
    x, y = (flat.field(k).to_pylist() for k in range(2))
    if flat.null_count:
        x = [None if n else v for n, v in zip(flat.is_null().to_pylist(), x, strict=True)]
    points = list(zip(x, y, strict=True))
    ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())]).tolist()
    return (points[a:b] for a, b in zip(ends, ends[1:], strict=False))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by block (key, block, id, next, x, y) to chains within their block: (key, head, after, points); a closed one has no after."""

    def joined(key: int, rows: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
        after = {i: (n, (x, y)) for i, n, x, y in rows}
        heads = after.keys() - {n for n, _ in after.values()}
        for i in [*sorted(heads), *after]:  # open chains first, what is left are rings
            if i in after:
                at, points = i, []
                while at in after:
                    at, p = after.pop(at)
                    points.append(p)
                yield key, i, at if i in heads else None, points

    def send(found: list[tuple]) -> pa.RecordBatch:
        keys, heads, afters, points = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(heads, pa.int64()), pa.array(afters, pa.int64()), points_column(list(points))], ["key", "head", "after", "points"])

    group, rows, found = None, [], []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:2] != group:
                if rows:
                    found += joined(group[0], rows)
                group, rows = r[:2], []
                if len(found) > 1000:
                    yield send(found)
                    found = []
            rows.append(r[2:])
    if rows:
        found += joined(group[0], rows)
    yield send(found)


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rings without points on straight sides, from their smallest point on."""
    for b in batches:
        out = []
        for ring in lists_of(b.column(1)):
            bends = [q for p, q, r in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]], strict=True) if (q[0] - p[0]) * (r[1] - q[1]) != (q[1] - p[1]) * (r[0] - q[0])]
            k = bends.index(min(bends)) if bends else 0
            out.append(bends[k:] + bends[:k])
        yield pa.RecordBatch.from_arrays([b.column(0), points_column(out)], ["key", "ring"])


def rank_cycles(nodes: DataFrame) -> DataFrame:
    """(id, first, steps) of nodes(id, next) that form cycles: the smallest id of the node's cycle and the steps to it.

    Pointers double each round, so a cycle of n nodes takes about log2(n) rounds of one join."""
    state = materialize(nodes.select("id", F.col("next").alias("ptr"), F.col("id").alias("first"), F.lit(0).cast("long").alias("steps")), "cycles")
    for turn in count():
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("beyond"), F.col("first").alias("f"), (F.col("steps") + (1 << turn)).alias("s"))
        better = F.col("f") < F.col("first")
        state = materialize(
            state.join(ahead, "ptr").select("id", F.col("beyond").alias("ptr"), F.when(better, F.col("f")).otherwise(F.col("first")).alias("first"), F.when(better, F.col("s")).otherwise(F.col("steps")).alias("steps")), "cycles"
        )
        along = nodes.join(state.select("id", "first"), "id").join(state.select(F.col("id").alias("next"), F.col("first").alias("f")), "next")
        if along.where("first <> f").isEmpty():
            return state.select("id", "first", "steps")


def rings_of_edges(edges: DataFrame, cell: int, at_once: int = AT_ONCE) -> DataFrame:
    """(key, ring) out of edges(key long, x0, y0, x1, y1 long) with the inside on their left; as many edges end at a point as start there.

    At a point an edge goes on along the first edge clockwise from where it came, so rings follow one face of the inside. A ring starts
    at its smallest point and has no points on straight sides; outer ones are anticlockwise, holes clockwise."""
    e = materialize(edges.select("key", "x0", "y0", "x1", "y1", F.monotonically_increasing_id().alias("id")), "edges")
    come = e.select("key", F.col("x1").alias("x"), F.col("y1").alias("y"), "id", F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")).alias("back"))
    go = e.select("key", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("id").alias("next"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("on"))
    turn = F.when(F.col("back") > F.col("on"), F.col("back") - F.col("on")).otherwise(F.col("back") - F.col("on") + 2 * F.pi())
    paired = come.join(go, ["key", "x", "y"]).groupBy("id").agg(F.min_by("next", turn).alias("next"))
    crowded = e.groupBy("key").count().where(F.col("count") > at_once).select("key", F.lit(True).alias("crowded"))
    place = F.xxhash64(F.floor(F.col("x0") / (8 * cell)), F.floor(F.col("y0") / (8 * cell)))
    rows = e.join(paired, "id").join(crowded, "key", "left").select("key", F.when(F.col("crowded"), place).otherwise(0).alias("block"), "id", "next", "x0", "y0")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chains = rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block").mapInArrow(_chains, f"key long, head long, after long, points {POINTS}")
    chains = materialize(chains, "chains")
    rings = chains.where("after IS NULL").select("key", "points")
    open_ = chains.where("after IS NOT NULL")
    if not open_.isEmpty():
        ranks = rank_cycles(open_.select(F.col("head").alias("id"), F.col("after").alias("next")))
        placed = open_.join(ranks, open_["head"] == ranks["id"])
        # the cycle's first chain has no steps to go, the others follow it from the farthest on
        place = F.when(F.col("steps") == 0, F.lit(-(1 << 62))).otherwise(-F.col("steps"))
        whole = placed.groupBy("key", "first").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "points"))).alias("parts"))
        rings = rings.unionByName(whole.select("key", F.flatten(F.transform("parts", lambda p: p.points)).alias("points")))
    return rings.mapInArrow(_rounded, f"key long, ring {POINTS}").where(F.size("ring") > 2)
