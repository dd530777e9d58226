"""Between shapes and pixels: painted layers, rings of masks. Pixel (x, y) covers x to x + 1 and y to y + 1 and counts by its middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import rings
from sitelens.operators.tracing import rings_of_edges


def pixels_of(shapes: DataFrame) -> DataFrame:
    """(shape columns without ring, x, y): the pixels whose middles lie within shapes(shape, ..., ring of points), by parity; holes are
    further rings of the same shape and other columns.

    Edges give the places where they cross the middle of a row of pixels; the places of one shape and row in order are the spans'
    starts and ends by turns. No shape is gathered."""
    keep = [c for c in shapes.columns if c != "ring"]
    e = shapes.select(*keep, F.explode(rings._edges(F.col("ring"))).alias("e"))
    e = e.select(*keep, *[F.col(f"e.{p}.{c}").cast("double").alias(f"_{c}{p}") for p in "ab" for c in "xy"]).where("_ya <> _yb")
    low, high = F.least("_ya", "_yb"), F.greatest("_ya", "_yb")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1  # rows whose middles lie in [low, high)
    e = e.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    at = F.col("_xa") + (F.col("y") + 0.5 - F.col("_ya")) * (F.col("_xb") - F.col("_xa")) / (F.col("_yb") - F.col("_ya"))
    # the first pixel whose middle is not left of the edge
    e = e.select(*keep, "y", F.ceil(at - 0.5).alias("_at"))
    row = Window.partitionBy(*keep, "y").orderBy("_at")
    spans = e.withColumns({"_turn": F.row_number().over(row), "_to": F.lead("_at").over(row)}).where("_turn % 2 = 1 AND _to > _at")
    return spans.select(*keep, F.explode(F.sequence("_at", F.col("_to") - 1)).alias("x"), "y")


def painted(shapes: DataFrame) -> DataFrame:
    """(key, x, y, turn): of the shapes(key, shape, turn, ring) over a pixel the greatest turn, as if they were painted in that order."""
    return pixels_of(shapes).groupBy("key", "x", "y").agg(F.max("turn").alias("turn"))


def mask_rings(pixels: DataFrame, cell: int = 256) -> DataFrame:
    """(key, ring) of the sets of distinct pixels(key, x, y): outer rings anticlockwise, holes clockwise, corners only. Pixels that touch
    at a corner only are apart.

    Sides that two pixels share go by their counts before rings are joined."""
    x, y = F.col("x"), F.col("y")
    sides = F.array(*[F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), F.lit(up).alias("up"), F.lit(way).alias("way")) for a, b, up, way in ((x, y, False, 1), (x + 1, y, True, 1), (x, y + 1, False, -1), (x, y, True, -1))])
    s = pixels.select("key", F.explode(sides).alias("s")).groupBy("key", "s.x", "s.y", "s.up").agg(F.sum("s.way").alias("way")).where("way <> 0")
    to_x, to_y = x + F.when(F.col("up"), 0).otherwise(1), y + F.when(F.col("up"), 1).otherwise(0)
    ahead = F.col("way") > 0
    pick = lambda a, b: F.when(ahead, a).otherwise(b)
    edges = s.select("key", pick(x, to_x).alias("x0"), pick(y, to_y).alias("y0"), pick(to_x, x).alias("x1"), pick(to_y, y).alias("y1"))
    return rings_of_edges(edges, cell)
