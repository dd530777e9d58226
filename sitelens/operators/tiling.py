"""Adaptive tiles: over-full tiles are quartered, and quartered again, to a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_tiles(points: DataFrame, boxes: DataFrame, step: float, depth: int = 3) -> DataFrame:
    """points(lon, lat, ...) with region, i, j of their tile of boxes(region, west, south, east, north) and cx, cy, their place in the tile's
    grid of 2^depth by 2^depth cells. Regions are a short fixed list, so they are broadcast; a point in several comes once for each."""
    n = 1 << depth
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    found = points.join(F.broadcast(boxes), inside)
    for at, low, high, tile, cell in (("lon", "west", "east", "i", "cx"), ("lat", "south", "north", "j", "cy")):
        last = F.greatest(F.ceil((F.col(high) - F.col(low) - 1e-12) / step).cast("int"), F.lit(1)) - 1
        found = found.withColumn(tile, F.least(F.floor((F.col(at) - F.col(low)) / step).cast("int"), last))
        start = F.col(low) + F.col(tile) * step
        wide = F.least(start + step, F.col(high)) - start
        found = found.withColumn(cell, F.least(F.floor((F.col(at) - start) / wide * n).cast("int"), F.lit(n - 1)))
    return found.drop("west", "south", "east", "north")


def leaves(placed: DataFrame, capacity: int, depth: int = 3) -> DataFrame:
    """(region, i, j, level, lx, ly, n, full): the used leaves of each tile's quadtree. A tile or quarter with more than capacity
    points is quartered; at the greatest depth it is reported as full.

    Cells are counted once, combined before the shuffle; all levels follow from the counts, so no point is read again."""
    tile = ["region", "i", "j"]
    cells = placed.groupBy(*tile, "cx", "cy").agg(F.count("*").alias("n"))
    at = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    nodes = at.groupBy(*tile, "level", up("cx").alias("lx"), up("cy").alias("ly")).agg(F.sum("n").alias("n"))
    fine = (F.col("n") <= capacity) | (F.col("level") == depth)
    parent = nodes.where((F.col("level") < depth) & (F.col("n") > capacity)).select(*tile, (F.col("level") + 1).alias("level"), F.col("lx").alias("px"), F.col("ly").alias("py"))
    kept = nodes.where(fine).withColumns({"px": F.shiftright("lx", 1), "py": F.shiftright("ly", 1)})
    # a leaf's parent was over-full, or it is the whole tile
    below = kept.where("level > 0").join(parent, [*tile, "level", "px", "py"], "left_semi")
    return below.unionByName(kept.where("level = 0")).select(*tile, "level", "lx", "ly", "n", (F.col("n") > capacity).alias("full"))


def merged(placed: DataFrame, capacity: int, depth: int = 3) -> DataFrame:
    """(region, i, j, n, leaves, asked, full) of each used tile: what its leaves found together, and how many boxes were looked into (an
    over-full one and its four quarters)."""
    tile = ["region", "i", "j"]
    found = leaves(placed, capacity, depth)
    # each distinct over-full ancestor was split once
    split = found.where("level > 0").withColumn("above", F.explode(F.sequence(F.lit(1), F.col("level"))))
    split = split.select(*tile, (F.col("level") - F.col("above")).alias("level"), F.expr("shiftright(lx, above)").alias("x"), F.expr("shiftright(ly, above)").alias("y")).distinct().groupBy(*tile).agg(F.count("*").alias("splits"))
    whole = found.groupBy(*tile).agg(F.sum("n").alias("n"), F.count("*").alias("leaves"), F.count_if("full").alias("full"))
    return whole.join(split, tile, "left").select(*tile, "n", "leaves", (F.coalesce("splits", F.lit(0)) * 4 + 1).alias("asked"), "full")
