"""Shapes out of many rows: convex hulls, rings of relations, grids of cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import rings


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, anticlockwise, without points on its sides."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _hull_rows(frame: pd.DataFrame) -> Iterator[tuple[int, float, float]]:
    for key, part in frame.groupby("key"):
        yield from ((key, x, y) for x, y in _chain(list(zip(part["x"], part["y"], strict=True))))


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame(list(_hull_rows(frame)), columns=["key", "x", "y"]).astype({"key": "int64", "x": "float64", "y": "float64"})


def hulls(points: DataFrame) -> DataFrame:
    """(key, ring) for points (key long, x, y): the convex hull, anticlockwise; of one or two distinct points those points. Points with
    nulls are ignored.

    A hull of hulls is the hull: batches are reduced where they are read, so what a key sends to its one task is corners only."""
    clean = points.select("key", "x", "y").where("key IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    corners = clean.mapInPandas(_partial, "key long, x double, y double")

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        ring = [{"x": x, "y": y} for _, x, y in _hull_rows(frame)]
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "ring": [ring]})

    return corners.groupBy("key").applyInPandas(whole, "key long, ring array<struct<x:double,y:double>>")


#: Ends of ways are the same point when they agree to so many digits of a degree.
DIGITS = 9


def _joined(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings out of lines that meet at ends. Each end knows its lines, so a ring is one walk over them: from the first unused line on to
    its end's next line, whichever way that runs, until no line is left there; then from its start the other way. Each line is used once, an
    open walk is closed."""
    end_of = lambda p: (round(p[0], DIGITS), round(p[1], DIGITS))
    at: dict[tuple[float, float], list[int]] = {}
    for k in range(len(lines) - 1, -1, -1):  # so that pop gives the earliest
        for p in (lines[k][0], lines[k][-1]):
            at.setdefault(end_of(p), []).append(k)
    used = [False] * len(lines)

    def walk(start: tuple[float, float]) -> list[tuple[float, float]]:
        points: list[tuple[float, float]] = []
        here = start
        while waiting := at[end_of(here)]:
            k = waiting.pop()
            if not used[k]:
                used[k] = True
                onward = lines[k] if end_of(lines[k][0]) == end_of(here) else lines[k][::-1]
                points += onward[1:]
                here = points[-1]
        return points

    out = []
    for k, line in enumerate(lines):
        if not used[k]:
            used[k] = True
            ring = [*line, *walk(line[-1])]
            ring = [*walk(line[0])[::-1], *ring]
            ring = ring[:-1] if end_of(ring[0]) == end_of(ring[-1]) else ring
            if len(ring) >= 3:
                out.append(ring)
    return out


def relation_rings(members: DataFrame) -> DataFrame:
    """(relation, role, ring) out of members (relation long, place, role, points): ways joined at their ends in the order of place, inner
    ones and all others (outer) apart. Ways of fewer than two points and rings of fewer than three corners are dropped.

    A relation's members are gathered (what one edited object holds, some ten thousand at most by the data model)."""
    kind = F.when(F.col("role") == "inner", "inner").otherwise("outer").alias("role")
    ways = members.where(F.size("points") >= 2).select("relation", kind, F.struct("place", "points").alias("way"))
    ways = ways.groupBy("relation", "role").agg(F.array_sort(F.collect_list("way")).alias("ways"))
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("relation", pa.int64()), ("role", pa.string()), ("ring", pa.list_(point))])

    def rings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines = [[(p["x"], p["y"]) for p in w["points"]] for w in r["ways"]]
                rows += [{"relation": r["relation"], "role": r["role"], "ring": [{"x": x, "y": y} for x, y in ring]} for ring in _joined(lines)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ways.mapInArrow(rings_of, "relation long, role string, ring array<struct<x:double,y:double>>")


# Metres of a degree of longitude (at the equator) and of latitude, least and most cells of an axis, cells' values.
MX, MY, LEAST, MOST = 111_320.0, 110_540.0, 8, 512
BLOCKED, FREE, UNKNOWN = 0, 254, 205


def occupancy(areas: DataFrame, blocks: DataFrame, resolution: float) -> DataFrame:
    """(site, width, height, row, col, value): cells of about resolution metres over areas (site, ring: free ground), from the north-west.

    A cell counts by its centre: blocked within a box of blocks (site, w, s, e, n), else free within the ring, else unknown. Cells of an
    area are bounded by 512 x 512; a block meets only the cells in its own extent."""
    a = areas.select("site", "ring", rings.bounds(F.col("ring")).alias("b")).select("site", "ring", "b.*")
    cells = lambda d: F.least(F.greatest(F.floor(d / resolution).cast("int"), F.lit(LEAST)), F.lit(MOST))
    a = a.withColumn("width", cells((F.col("east") - F.col("west")) * (F.lit(MX) * F.cos(F.radians((F.col("south") + F.col("north")) / 2))))).withColumn("height", cells((F.col("north") - F.col("south")) * MY))
    x = F.col("west") + (F.col("col") + 0.5) * (F.col("east") - F.col("west")) / F.col("width")
    y = F.col("north") - (F.col("row") + 0.5) * (F.col("north") - F.col("south")) / F.col("height")
    grid = a.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    grid = grid.select("site", "width", "height", "row", "col", rings.contains(F.col("ring"), x, y).alias("free"))
    at = lambda v, low, span, n: F.floor((v - low) / span * F.col(n)).cast("int")
    wide, high = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    hit = blocks.join(a.drop("ring"), "site").withColumns({"c0": F.greatest(at(F.col("w"), F.col("west"), wide, "width"), F.lit(0)), "c1": F.least(at(F.col("e"), F.col("west"), wide, "width"), F.col("width") - 1)})
    hit = hit.withColumns({"r0": F.greatest(F.floor((F.col("north") - F.col("n")) / high * F.col("height")).cast("int"), F.lit(0)), "r1": F.least(F.floor((F.col("north") - F.col("s")) / high * F.col("height")).cast("int"), F.col("height") - 1)})
    hit = hit.where("c0 <= c1 AND r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    hit = hit.where((x > F.col("w")) & (x < F.col("e")) & (y > F.col("s")) & (y < F.col("n"))).select("site", "row", "col").distinct().withColumn("_hit", F.lit(True))
    value = F.when(F.col("_hit"), BLOCKED).when(F.col("free"), FREE).otherwise(UNKNOWN)
    return grid.join(hit, ["site", "row", "col"], "left").select("site", "width", "height", "row", "col", value.alias("value"))
