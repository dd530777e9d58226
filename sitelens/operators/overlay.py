"""Overlay of shapes on an integer grid: union, intersection, difference, and what follows from them.

A key of few edges is worked on whole. Rings of others are cut along tile lines, so no task holds more than a tile; where a tile has too
many edges it is quartered. Within a tile or key, edges are split where they meet (crossings are rounded to the grid until none is left), winding numbers to both sides
of every piece tell whether it divides the inside of the result from its outside. Pieces on tile lines cancel against those of the tile
beyond; what stays are the result's edges, and tracing joins them to rings.

A shape is given by its rings: outer ones turn anticlockwise, holes clockwise, so winding numbers of a side's shapes add up and a hole
that another shape covers is covered. Rows with null keys, rings or points are ignored, as are rings of fewer than three points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import rings
from sitelens.operators import arrangement
from sitelens.operators.tracing import AT_ONCE, POINTS, rings_of_edges
from sitelens.sources.scratch import materialize

Point = tuple[int, int]
#: Tile size in units of the grid, edges of a tile that are split at once, edges of a key that is not dealt by tiles, edges of the groups
#: that are split in one step.
TILE, CROWDED, WHOLE, AT_A_TIME = 1 << 17, 400, 10_000, 30_000


def snapped(ring: Column, scale: float) -> Column:
    """A ring of doubles on the integer grid of 1 / scale."""
    return F.transform(ring, lambda p: F.struct(F.round(p.x * scale).cast("long").alias("x"), F.round(p.y * scale).cast("long").alias("y")))


def unsnapped(ring: Column, scale: float) -> Column:
    return F.transform(ring, lambda p: F.struct((p.x / scale).alias("x"), (p.y / scale).alias("y")))


def turned(ring: Column, hole: Column) -> Column:
    """The ring, anticlockwise or (a hole) clockwise."""
    return F.when((rings.signed_area(ring) < 0) != hole, F.reverse(ring)).otherwise(ring)


def halves(ring: list[Point], axis: int, at: int) -> tuple[list[Point], list[Point]]:
    """The parts of a ring at either side of a line; where an edge crosses it, both get the same rounded point, whichever way it runs."""
    low: list[Point] = []
    high: list[Point] = []
    for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
        if p[axis] <= at:
            low.append(p)
        if p[axis] >= at:
            high.append(p)
        if (p[axis] - at) * (q[axis] - at) < 0:
            a, b = (p, q) if p[axis] < q[axis] else (q, p)
            wide = b[axis] - a[axis]
            across = a[1 - axis] + (2 * (b[1 - axis] - a[1 - axis]) * (at - a[axis]) + wide) // (2 * wide)
            cut = (at, across) if axis == 0 else (across, at)
            low.append(cut)
            high.append(cut)
    return low, high


def tiled(ring: list[Point], size: int) -> Iterator[tuple[int, int, list[Point]]]:
    """(tile column, tile row, part) of a ring: columns are cut first, then rows, each at the middle line of what is left."""
    todo = [(0, ring, 0)]
    while todo:
        axis, part, column = todo.pop()
        low, high = min(p[axis] for p in part), max(p[axis] for p in part)
        first, last = low // size, max((high - 1) // size, low // size)
        if first < last:
            a, b = halves(part, axis, (first + last + 1) // 2 * size)
            todo += [(axis, x, column) for x in (a, b) if len(x) > 2]
        elif axis == 0:
            todo.append((1, part, first))
        else:
            yield column, first, part


#: Whether winding numbers (one column a side) lie inside the result.
OPERATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "union": lambda w: (w != 0).any(axis=1),
    "intersection": lambda w: (w != 0).all(axis=1),
    "difference": lambda w: (w[:, 0] != 0) & (w[:, 1:] == 0).all(axis=1),
    "parity": lambda w: (w % 2 != 0).any(axis=1),
}


def _rings_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, ends) of an Arrow column of rings; null points are left out."""
    flat, size = column.flatten(), np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    x, y = (flat.field(k) for k in range(2))
    if flat.null_count or x.null_count or y.null_count:
        live = np.array(pc.and_(pc.is_valid(flat), pc.and_(pc.is_valid(x), pc.is_valid(y))))
        of = np.repeat(np.arange(len(size)), size)
        size = np.bincount(of[live], minlength=len(size))
        x, y = x.filter(pa.array(live)), y.filter(pa.array(live))
    return np.array(x, np.int64), np.array(y, np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _list_column(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))


def _retiled(pieces: DataFrame, size: int) -> DataFrame:
    """pieces(key, side, ring) by tile: (key, tx, ty, size, side, ring, edges)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, side = (np.array(c, np.int64) for c in b.columns[:2])
            found = _rings_of(b.column(2))
            if b.num_columns > 3:
                found = arrangement.turned(*found, np.array(b.column(3)))
            rings = np.flatnonzero(np.diff(found[-1]) > 2)
            at, tx, ty, x, y, ends = arrangement.tiled(*arrangement.taken(*found, rings), size)
            at = rings[at]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key[at], tx, ty)), pa.array(side[at], pa.int32()), _list_column(x, y, ends), pa.array(np.diff(ends))], ["key", "tx", "ty", "side", "ring", "edges"])

    return pieces.select("key", "side", "ring", *(["hole"] if "hole" in pieces.columns else [])).mapInArrow(cut, f"key long, tx long, ty long, side int, ring {POINTS}, edges long").withColumn("size", F.lit(size).cast("long"))


def _groups(batches: Iterator[pa.RecordBatch], names: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups of rows sorted by their first columns, some AT_A_TIME edges each time: (values of each group, group of each ring, side,
    x, y, ends)."""
    held: list[pa.RecordBatch] = []

    def send(rows: pa.Table) -> Iterator[tuple]:
        b = rows.combine_chunks()
        values = np.stack([b.column(k).to_numpy() for k in range(names)], axis=1)
        side, column = b.column(names).to_numpy().astype(np.int64), b.column(names + 1)
        x, y, ends = _rings_of(column.chunk(0) if column.num_chunks else pa.array([], column.type))
        if b.num_columns > names + 2:
            x, y, ends = arrangement.turned(x, y, ends, b.column(names + 2).to_numpy())
        heads = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(axis=1)]))
        bounds, at = [*heads.tolist(), len(values)], 0
        while at < len(heads):
            end = at + 1
            end = max(end, int(np.searchsorted(ends[bounds], ends[bounds[at]] + AT_A_TIME, side="right")) - 1)
            lo, hi = bounds[at], bounds[end]
            rows = np.arange(lo, hi)
            rows = rows[np.diff(ends)[lo:hi] > 2]
            group = np.searchsorted(heads[at:end], rows, side="right") - 1
            yield values[heads[at:end]], group, side[rows], *arrangement.taken(x, y, ends, rows)
            at = end

    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([np.array(b.column(k)) for k in range(names)], axis=1)
        new = np.flatnonzero((values[1:] != values[:-1]).any(axis=1))
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(names)):
            yield from send(pa.Table.from_batches(held))
            held = []
        if len(new):
            yield from send(pa.Table.from_batches([*held, b.slice(0, new[-1] + 1)]))
            held, b = [], b.slice(new[-1] + 1)
        held.append(b)
    if held:
        yield from send(pa.Table.from_batches(held))


def _cleaned(shapes: DataFrame, operations: list[str]) -> DataFrame:
    hole = [F.coalesce("hole", F.lit(False)).alias("hole")] if "hole" in shapes.columns else []
    clean = shapes.where("key IS NOT NULL AND side IS NOT NULL AND ring IS NOT NULL").select(F.col("key").cast("long").alias("key"), F.col("side").cast("int").alias("side"), "ring", *hole)
    return clean if _sides(operations) == 2 else clean.withColumn("side", F.lit(0))


def _sides(operations: list[str]) -> int:
    """One side is all for unions and parities."""
    return 1 if set(operations) <= {"union", "parity"} else 2


def result_edges(shapes: DataFrame, operation: str, tile: int = TILE, crowded: int = CROWDED) -> DataFrame:
    """(key, x0, y0, x1, y1) of the result of an operation on shapes(key long, side int, ring of whole points, hole if rings are still to be
    turned), the inside to their left."""
    sides, inside = _sides([operation]), OPERATIONS[operation]
    tile = min(tile, arrangement.SPAN)
    size, done, rest = tile, None, _cleaned(shapes, [operation])
    while True:
        pieces = materialize(_retiled(rest, size), "pieces")
        full = pieces.groupBy("key", "tx", "ty").agg(F.sum("edges").alias("n")).where(F.col("n") > crowded).select("key", "tx", "ty")
        if size < 4 or size % 2 or full.isEmpty():
            done = pieces if done is None else done.unionByName(pieces)
            break
        small = pieces.join(full, ["key", "tx", "ty"], "left_anti")
        done = small if done is None else done.unionByName(small)
        rest, size = pieces.join(full, ["key", "tx", "ty"], "left_semi"), size // 2

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, group, *rings_ in _groups(batches, 4):
            [(of, edges)] = arrangement.solved(group, *rings_, sides, [inside])
            low, width = values[of, 1:3] * values[of, 3:], values[of, 3]
            # a level or upright edge on a tile line: which axis, else -1
            line = np.full(len(edges), -1)
            for axis in (0, 1):
                on = (edges[:, axis] == edges[:, axis + 2]) & ((edges[:, axis] == low[:, axis]) | (edges[:, axis] == low[:, axis] + width))
                line[on] = axis
            yield pa.RecordBatch.from_arrays([pa.array(values[of, 0]), *(pa.array(edges[:, k]) for k in range(4)), pa.array(line, pa.int32())], ["key", "x0", "y0", "x1", "y1", "line"])

    names = ["key", "tx", "ty", "size"]
    # tiles are few bytes but much work, so partitions are not merged by size
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = done.select(*names, "side", "ring").repartition(parts, *names).sortWithinPartitions(*names)
    edges = materialize(rows.mapInArrow(solve, "key long, x0 long, y0 long, x1 long, y1 long, line int"), "result")
    return edges.where("line < 0").drop("line").unionByName(_uncancelled(edges.where("line >= 0"), tile))


def _uncancelled(edges: DataFrame, tile: int) -> DataFrame:
    """Edges on tile lines without what the tiles at both sides have in opposite directions.

    On each line the directions are summed up between neighbouring ends; a line is dealt in stretches of a tile."""
    x = F.col("line") == 0  # upright: runs along y
    a, b = F.when(x, F.col("y0")).otherwise(F.col("x0")), F.when(x, F.col("y1")).otherwise(F.col("x1"))
    on = F.when(x, F.col("x0")).otherwise(F.col("y0"))
    e = edges.select("key", "line", on.alias("at"), F.floor(F.least(a, b) / tile).alias("part"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.signum(b - a).cast("long").alias("way"))
    ends = e.select("key", "line", "at", "part", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("way")), F.struct(F.col("hi").alias("pos"), (-F.col("way")).alias("way")))).alias("s"))
    ends = ends.groupBy("key", "line", "at", "part", F.col("s.pos").alias("pos")).agg(F.sum("s.way").alias("way"))
    along = Window.partitionBy("key", "line", "at", "part").orderBy("pos")
    net = ends.withColumn("net", F.sum("way").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("pos").over(along)).where("net <> 0 AND to IS NOT NULL")
    p, q = F.when(F.col("net") > 0, F.col("pos")).otherwise(F.col("to")), F.when(F.col("net") > 0, F.col("to")).otherwise(F.col("pos"))
    x = F.col("line") == 0
    return net.select("key", F.when(x, F.col("at")).otherwise(p).alias("x0"), F.when(x, p).otherwise(F.col("at")).alias("y0"), F.when(x, F.col("at")).otherwise(q).alias("x1"), F.when(x, q).otherwise(F.col("at")).alias("y1"))


def _whole(shapes: DataFrame, operations: list[str]) -> DataFrame:
    """(operation, key, ring) of operations on shapes(key, side, ring, hole) of small keys, each as one arrangement."""
    sides, insides = _sides(operations), [OPERATIONS[op] for op in operations]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, group, *rings_ in _groups(batches, 1):
            for op, found in zip(operations, arrangement.solved(group, *rings_, sides, insides), strict=True):
                of, ends, points = arrangement.traced(*found)
                yield pa.RecordBatch.from_arrays([pa.array([op] * len(of), pa.string()), pa.array(values[of, 0]), _list_column(points[:, 0], points[:, 1], ends)], ["operation", "key", "ring"])

    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shapes.select("key", "side", "ring", *(["hole"] if "hole" in shapes.columns else [])).repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(solve, f"operation string, key long, ring {POINTS}")


def overlay(shapes: DataFrame, operation: str, tile: int = TILE, crowded: int = CROWDED, at_once: int = AT_ONCE) -> DataFrame:
    """(key, ring) of the union, intersection, difference (side 0 without the others) or parity of shapes(key, side, ring): outer rings
    anticlockwise, holes clockwise. With a column hole, rings are turned by it first."""
    return overlays(shapes, [operation], tile, crowded, at_once).drop("operation")


def overlays(shapes: DataFrame, operations: list[str], tile: int = TILE, crowded: int = CROWDED, at_once: int = AT_ONCE) -> DataFrame:
    """(operation, key, ring) of several operations on the same shapes.

    A key of few edges that lie close together is one arrangement, in one task; others are dealt by tiles."""
    ring = F.col("ring")
    clean = _cleaned(shapes, operations)
    clean = materialize(clean.select("*", F.size(ring).cast("long").alias("n"), *[f(ring[c]).alias(f"{c}{k}") for k, f in enumerate((F.array_min, F.array_max)) for c in "xy"]), "shapes")
    least = min(at_once, WHOLE)
    wide = F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"))
    large = clean.groupBy("key").agg(F.sum("n").alias("n"), wide.alias("wide")).where((F.col("n") > least) | (F.col("wide") > arrangement.SPAN)).select("key")
    large = materialize(large, "large")
    if large.isEmpty():
        return _whole(clean, operations)
    out, tiles = _whole(clean.join(large, "key", "left_anti"), operations), clean.join(large, "key", "left_semi")
    for op in operations:
        far = rings_of_edges(result_edges(tiles, op, tile, crowded), tile, at_once)
        out = out.unionByName(far.select(F.lit(op).alias("operation"), "key", "ring"))
    return out


def measured(rings_: DataFrame, *keep: str) -> DataFrame:
    """(keep, area, border): signed area and length of each ring of whole points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = arrangement.measures(*_rings_of(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in found)], [*keep, "area", "border"])

    rows = rings_.select(*keep, "ring")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kinds}, area double, border double")
