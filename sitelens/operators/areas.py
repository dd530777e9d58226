"""What follows from overlays: dissolved layers, buffers inwards and outwards, collars, repaired rings, shapes with their holes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import rings
from sitelens.operators.overlay import TILE, overlay, overlays, turned
from sitelens.operators.tracing import POINTS, lists_of, points_column
from sitelens.sources.scratch import materialize

#: Sides of a circle that stand for an arc all round.
ROUND = 64


def side(shapes: DataFrame, number: int) -> DataFrame:
    """shapes(key, ring, hole) as one side of an overlay, which turns them."""
    return shapes.select("key", F.lit(number).alias("side"), "ring", F.coalesce("hole", F.lit(False)).alias("hole"))


def _edge(shapes: DataFrame, width: float, number: int) -> DataFrame:
    """The margin of shapes(key, ring, hole) as one side of an overlay; rings must turn so that their inside is on the left."""
    own = shapes.select("key", turned(F.col("ring"), F.coalesce("hole", F.lit(False))).alias("ring"))
    return _mapped(own, lambda ring: margin(ring, width)).select("key", F.lit(number).alias("side"), "ring", F.lit(False).alias("hole"))


def dissolve(shapes: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, ring): the union of all shapes(key, ring, hole) of a key. Only tiles are gathered, so a key may be a whole layer."""
    return overlay(side(shapes, 0), "union", tile)


def combined(a: DataFrame, b: DataFrame, operation: str, tile: int = TILE) -> DataFrame:
    """(key, ring) of an operation on the shapes(key, ring, hole) of a and b of equal keys."""
    return overlay(side(a, 0).unionByName(side(b, 1)), operation, tile)


def all_combined(a: DataFrame, b: DataFrame, operations: list[str], tile: int = TILE) -> DataFrame:
    """(operation, key, ring) of several operations, which are worked out together."""
    return overlays(side(a, 0).unionByName(side(b, 1)), operations, tile)


def subtracted(shapes: DataFrame, masks: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, ring): what masks(key, ring, hole) leave of shapes(key, ring, hole)."""
    return combined(shapes, masks, "difference", tile)


def repaired(shapes: DataFrame, least: float = 0.0, deviation: float = 0.0, tile: int = TILE) -> DataFrame:
    """(key, ring) of single rings (key, ring) that may cross themselves: inside is what an odd number of turns surrounds. Rings are
    simplified by greatest deviation; those of at most the least area go."""
    fixed = overlay(shapes.select("key", F.lit(0).alias("side"), "ring"), "parity", tile)
    fixed = simplified(fixed, deviation) if deviation > 0 else fixed
    return fixed.where(rings.area(F.col("ring")) > least)


def _mapped(df: DataFrame, use: Callable[[list[tuple[int, int]]], list[list[tuple[int, int]]]]) -> DataFrame:
    """(key, ring) with each ring replaced by those that use gives for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, out) for k, ring in zip(b.column(0).to_pylist(), lists_of(b.column(1)), strict=True) for out in use(ring)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), points_column([r for _, r in found])], ["key", "ring"])

    return df.select("key", "ring").where("ring IS NOT NULL").mapInArrow(run, f"key long, ring {POINTS}")


def keep_corners(ring: list[tuple[int, int]], deviation: float) -> list[tuple[int, int]]:
    """A ring without points that lie within the deviation of what stays: halves between far points keep their farthest one while it
    deviates more."""
    points = np.array(ring, np.int64)
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    points = np.vstack([points, points[:1]])
    stay, todo = {0, far}, [(0, far), (far, len(ring))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = points[b] - points[a], points[a + 1 : b] - points[a]
        size = math.hypot(*d.tolist())
        off = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / size if size else np.hypot(v[:, 0], v[:, 1])
        k = int(np.argmax(off))
        if off[k] > deviation:
            stay.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [ring[k] for k in sorted(stay) if k < len(ring)]


def simplified(shapes: DataFrame, deviation: float) -> DataFrame:
    """(key, ring) without points that deviate at most so much; rings of fewer than three corners go."""

    def use(ring: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        out = keep_corners(ring, deviation) if len(ring) > 2 else []
        return [out] if len(out) > 2 else []

    return _mapped(shapes, use)


def margin(ring: list[tuple[int, int]], width: float) -> list[list[tuple[int, int]]]:
    """Convex pieces that cover what lies within the width beyond the edges (right of them; left where the width is negative): a
    rectangle along each edge, a sector about each corner that it turns round."""
    out = []
    corners = [p for p, q in zip(ring, [*ring[1:], ring[0]], strict=True) if p != q]
    turn = 1 if width > 0 else -1
    normals = []
    for p, q in zip(corners, [*corners[1:], *corners[:1]], strict=True):
        dx, dy = q[0] - p[0], q[1] - p[1]
        size = math.hypot(dx, dy)
        n = (dy / size * width, -dx / size * width)
        normals.append(n)
        out.append([p, (round(p[0] + n[0]), round(p[1] + n[1])), (round(q[0] + n[0]), round(q[1] + n[1])), q])
    for p, a, b in zip(corners, [normals[-1], *normals[:-1]] if normals else [], normals, strict=True):
        start = math.atan2(a[1], a[0])
        span = (math.atan2(b[1], b[0]) - start) * turn % (2 * math.pi)
        if 1e-12 < span <= math.pi + 1e-9:
            steps = max(1, math.ceil(span / (2 * math.pi / ROUND)))
            arc = [(start + turn * span * k / steps) for k in range(steps + 1)]
            out.append([p, *((round(p[0] + abs(width) * math.cos(t)), round(p[1] + abs(width) * math.sin(t))) for t in arc)])
    return [r if turn > 0 else r[::-1] for r in out]


def buffered(shapes: DataFrame, width: float, tile: int = TILE) -> DataFrame:
    """(key, ring): shapes(key, ring, hole) grown by a width in grid units, or shrunk by a negative one; corners become arcs of ROUND sides.

    Rings turn so that their inside is on the left, so the margin of every ring, a hole's too, lies where the shape ends. What overlaps is
    resolved by winding numbers in the overlay."""
    edge = _edge(shapes, width, 0 if width > 0 else 1)
    return overlay(side(shapes, 0).unionByName(edge), "union" if width > 0 else "difference", tile)


def collars(shapes: DataFrame, width: float, near: Callable[[DataFrame], DataFrame], tile: int = TILE) -> DataFrame:
    """(key, ring): what lies within the width of shapes(key, ring, hole) and in none of near(keys): rows (key, ring, hole) of the
    shapes, itself included, and other ground that a key's collar must spare."""
    return overlay(side(shapes, 0).unionByName(_edge(shapes, width, 0)).unionByName(side(near(shapes), 1)), "difference", tile)


def nested(result: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, outer, holes) of the rings (key, ring) of an overlay: each hole with the outer ring around it.

    From a hole's smallest point the nearest edge to the west belongs to the ring around it or to a hole beside it in that ring (then
    it takes that one's outer ring). Edges are listed by the rows of tiles that they span, so a hole meets one row's edges."""
    r = result.withColumn("area", rings.signed_area(F.col("ring"))).withColumn("id", F.xxhash64("key", "ring"))
    holes = r.where("area < 0").select("key", F.col("id").alias("hole"), F.col("ring")[0].x.alias("px"), F.col("ring")[0].y.alias("py"))
    holes = holes.withColumn("row", F.floor(F.col("py") / tile))
    edges = r.select("key", "id", (F.col("area") < 0).alias("inner"), F.explode(rings._edges(F.col("ring"))).alias("e")).select("key", "id", "inner", *[F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{p}") for p in "ab" for c in "xy"])
    edges = edges.where("ya <> yb").withColumn("row", F.explode(F.sequence(F.floor(F.least("ya", "yb") / tile), F.floor(F.greatest("ya", "yb") / tile))))
    # half a unit up, so that no edge ends on the ray
    y = F.col("py") + F.lit(0.5)
    x = F.col("xa") + (y - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    hit = holes.join(edges, ["key", "row"]).where(((F.col("ya") > y) != (F.col("yb") > y)) & (F.col("id") != F.col("hole")) & (x <= F.col("px")))
    beside = hit.groupBy("key", "hole").agg(F.max(F.struct(x.alias("x"), "id", "inner")).alias("m")).select("key", "hole", "m.id", "m.inner")
    known = beside.where(~F.col("inner")).select("key", "hole", F.col("id").alias("outer_id"))
    wait = beside.where("inner").select("key", "hole", F.col("id").alias("by"))
    while not (wait := materialize(wait, "holes")).isEmpty():  # holes in a line pass their outer ring on; each round doubles how far
        step = known.select("key", F.col("hole").alias("by"), "outer_id")
        now = known.unionByName(wait.join(step, ["key", "by"]).select("key", "hole", "outer_id"))
        far = wait.select("key", F.col("hole").alias("by"), F.col("by").alias("next"))
        wait = wait.join(step.select("key", "by"), ["key", "by"], "left_anti").join(far, ["key", "by"]).select("key", "hole", F.col("next").alias("by"))
        known = materialize(now, "outers")
    inner = known.join(r.select("key", F.col("id").alias("hole"), F.col("ring").alias("inside")), ["key", "hole"]).groupBy("key", "outer_id").agg(F.array_sort(F.collect_list("inside")).alias("holes"))
    outer = r.where("area > 0").select("key", F.col("id").alias("outer_id"), F.col("ring").alias("outer"))
    return outer.join(inner, ["key", "outer_id"], "left").select("key", "outer", F.coalesce("holes", F.array().cast(f"array<{POINTS}>")).alias("holes"))


def mercator(ring: Column, scale: float = 100.0) -> Column:
    """A ring of (lon, lat) in web-map metres on the integer grid of 1 / scale metres."""
    # Fixed value: the sphere's radius of web maps.
    size = 6378137.0 * scale
    return F.transform(ring, lambda p: F.struct(F.round(F.radians(p.x) * size).cast("long").alias("x"), F.round(F.log(F.tan(F.radians(p.y) / 2 + F.pi() / 4)) * size).cast("long").alias("y")))


def lonlat(ring: Column, scale: float = 100.0) -> Column:
    size = 6378137.0 * scale
    return F.transform(ring, lambda p: F.struct(F.degrees(p.x / size).alias("x"), F.degrees(2 * F.atan(F.exp(p.y / size)) - F.pi() / 2).alias("y")))
