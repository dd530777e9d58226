"""What holes lack, filled: greens from outlines at their pins, fairways matched to lines or drawn as corridors along them.

Shapes are rings of (x: lon, y: lat); holes(site, hole, number, ...) have unique ids hole, whose order is that of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import metric, rings
from sitelens.operators import areas, overlay, spatial
from sitelens.operators.fusion import metres_to
from sitelens.operators.refinement import COMPACT, FINE, GREEN_M2, GRID, compactness, grid_area, meeting, shared
from sitelens.sources.scratch import materialize

# Fixed values in metres: reach from a pin to an outline's pin, from the outline to its pin, from a line to its fairway, half width of a
# corridor; share of an outline that mapped greens may cover, least share and square metres of a corridor on grass.
SAME_PIN, HELD, BESIDE, HALF, COVERED, ON_GRASS, LEAST = 14.0, 8.0, 28.0, 22.0, 0.12, 0.22, 176.0


def filled_greens(holes: DataFrame, outlines: DataFrame, greens: DataFrame, reach: float = SAME_PIN) -> DataFrame:
    """(site, hole, number, outline, shape, decision) of the holes(green, lon, lat: of the pin) without a green.

    A hole takes the outline(site, outline, lon, lat, shape) of the pin nearest to its own and closer than reach, where that is a green
    by area and compactness, holds the pin and lies on no mapped green (site, shape). decision: filled, or skipped with shape NULL (no
    pin or outline, a failed test, or an earlier hole of the number is filled)."""
    open_ = materialize(holes.where("green IS NULL").select("site", "hole", "number", "lon", "lat"), "open")
    o = outlines.where(F.size("shape") > 2).select("site", "outline", F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    near = spatial.near(open_.where("lon IS NOT NULL AND lat IS NOT NULL"), o, reach / metric.METRES, ["site"]).where(F.sqrt("d2") * metric.METRES < reach)
    own = near.groupBy("hole").agg(F.min(F.struct("d2", "outline")).alias("b")).select("hole", "b.outline")
    met = open_.join(own, "hole").join(outlines.select("outline", "shape"), "outline")
    away = metres_to(F.col("shape"), F.lit(True), F.col("lon"), F.col("lat"))
    fine = metric.ellipsoid_area(F.col("shape")).between(*GREEN_M2) & (compactness(F.col("shape")) >= COMPACT) & (away < HELD)
    met = materialize(met.where(fine), "met")
    beside = materialize(meeting(met.select("site", F.col("hole").alias("id"), "shape"), greens.select("site", "shape"), ["site"]), "beside")
    both = shared(met.select(F.col("hole").alias("key"), "shape"), beside.select(F.col("a_id").alias("key"), F.col("b_shape").alias("shape")))
    over = met.join(both, F.col("hole") == F.col("key")).where(F.col("both") / F.abs(grid_area(overlay.snapped(F.col("shape"), GRID))) >= COVERED)
    good = met.join(over.select("hole"), "hole", "left_anti")
    first = good.groupBy("site", "number").agg(F.min("hole").alias("hole")).select("hole")
    good = good.join(first, "hole", "left_semi").select("hole", "outline", "shape")
    return open_.join(good, "hole", "left").select("site", "hole", "number", "outline", "shape", F.when(F.col("shape").isNotNull(), "filled").otherwise("skipped").alias("decision"))


def _plane(shape: Column) -> Column:
    """Web-map metres in units in which distances of degrees come out as metres."""

    def at(p: Column) -> Column:
        x, y = metric.mercator(p.x, p.y)
        return F.struct((x / metric.METRES).alias("x"), (y / metric.METRES).alias("y"))

    return F.transform(shape, at)


def gap(ring: Column, line: Column) -> Column:
    """Distance in metres between a ring, its inside included, and a line; 0 where they meet."""
    runs = F.slice(rings._edges(line), 1, F.greatest(F.size(line) - 1, F.lit(1)))
    side = lambda a, b, p: F.signum((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x))
    cross = F.exists(runs, lambda e: F.exists(rings._edges(ring), lambda f: (side(e.a, e.b, f.a) * side(e.a, e.b, f.b) < 0) & (side(f.a, f.b, e.a) * side(f.a, f.b, e.b) < 0)))
    from_line = F.array_min(F.transform(line, lambda p: metres_to(ring, F.lit(True), p.x, p.y)))
    from_ring = F.array_min(F.transform(ring, lambda p: metres_to(line, F.lit(False), p.x, p.y)))
    return F.when(cross, F.lit(0.0)).otherwise(F.least(from_line, from_ring))


def matched_fairways(fairways: DataFrame, holes: DataFrame, reach: float = BESIDE) -> DataFrame:
    """fairways(site, feat, shape, hole) with matched: the number of the first of holes(line) whose line passes within reach metres of
    the web map, else their own hole where the site has that number, else NULL."""
    f, h = materialize(fairways.select("site", F.col("feat").alias("id"), "shape", F.col("hole").alias("own")), "fairways"), holes.select("site", F.col("hole").alias("id"), "number", F.col("line").alias("shape"))
    # a metre of the web map is at most one of a degree; the margin is for its slightly larger sphere
    near = meeting(f.select("site", "id", "shape"), h, ["site"], 1.01 * reach / metric.METRES)
    near = near.withColumns({"_r": _plane(F.col("a_shape")), "_l": _plane(F.col("b_shape"))}).where(gap(F.col("_r"), F.col("_l")) <= reach)
    first = near.groupBy("a_id").agg(F.min(F.struct("b_id", "b_number")).alias("b")).select(F.col("a_id").alias("id"), F.col("b.b_number").alias("_by_line"))
    numbers = holes.select("site", F.col("number").alias("own"), F.col("number").alias("_own")).distinct()
    j = f.join(first, "id", "left").join(numbers, ["site", "own"], "left")
    return j.select("site", F.col("id").alias("feat"), "shape", F.col("own").alias("hole"), F.coalesce("_by_line", "_own").alias("matched"))


def corridors(holes: DataFrame, grass: DataFrame, spare: DataFrame, boundaries: DataFrame, half: float = HALF) -> DataFrame:
    """(hole, outer, holes, m2): what lies within half metres of the web map of each hole's line, on grass(site, shape) where enough of
    it does, without what is to spare(site, shape) and within the site's boundaries(site, shape), if it has any: the largest part."""
    lines = materialize(holes.where(F.size("line") > 0).select("site", F.col("hole").alias("id"), F.col("line").alias("shape")), "lines")
    pad = 1.01 * half / metric.METRES
    runs = F.slice(rings._edges(F.col("shape")), 1, F.greatest(F.size("shape") - 1, F.lit(1)))
    pieces = lines.select(F.col("id").alias("key"), F.explode(runs).alias("e")).select("key", metric.capsule(F.col("e.a.x"), F.col("e.a.y"), F.col("e.b.x"), F.col("e.b.y"), half).alias("shape"))
    on_grid = lambda df: df.select("key", areas.mercator(F.col("shape"), FINE).alias("ring"), F.lit(False).alias("hole"))
    whole = materialize(areas.dissolve(on_grid(pieces)), "corridors")
    beside = lambda df: on_grid(meeting(lines, df.select("site", "shape"), ["site"], pad).select(F.col("a_id").alias("key"), F.col("b_shape").alias("shape")))
    again = lambda df: df.withColumn("hole", grid_area(F.col("ring")) < 0)
    green = materialize(areas.combined(again(whole), beside(grass), "intersection"), "on_grass")
    size = lambda df, name: df.groupBy("key").agg(F.sum(_signed_m2(F.col("ring"))).alias(name))
    enough = size(green, "clip").join(size(whole, "all"), "key").where(F.col("clip") >= F.greatest(F.col("all") * ON_GRASS, F.lit(LEAST))).select("key")
    rest = green.join(enough, "key", "left_semi").unionByName(whole.join(enough, "key", "left_anti"))
    rest = materialize(areas.subtracted(again(rest), beside(spare)), "spared")
    inside = lines.join(boundaries.where(F.size("shape") > 2).select("site").distinct(), "site", "left_semi").select(F.col("id").alias("key"))
    held = areas.combined(again(rest.join(inside, "key", "left_semi")), beside(boundaries), "intersection")
    parts = areas.nested(materialize(held.unionByName(rest.join(inside, "key", "left_anti")), "parts"))
    m2 = _signed_m2(F.col("outer")) - F.aggregate("holes", F.lit(0.0), lambda s, r: s - _signed_m2(r))
    largest = parts.withColumn("m2", m2).groupBy("key").agg(F.max(F.struct("m2", "outer", "holes")).alias("b"))
    back = lambda r: areas.lonlat(r, FINE)
    return largest.select(F.col("key").alias("hole"), back(F.col("b.outer")).alias("outer"), F.transform("b.holes", back).alias("holes"), "b.m2")


def _signed_m2(ring: Column) -> Column:
    return F.signum(grid_area(ring)) * metric.ellipsoid_area(areas.lonlat(ring, FINE))


def derived_fairways(fairways: DataFrame, holes: DataFrame, grass: DataFrame, spare: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(site, feat, number, shape, holes, source): mapped fairways with their hole's number, and a corridor for the first hole of each
    number that none has; source is centerline_buffer for those."""
    matched = materialize(matched_fairways(fairways, holes), "matched")
    have = matched.where("matched IS NOT NULL").select("site", F.col("matched").alias("number")).distinct()
    bare = holes.join(have, ["site", "number"], "left_anti")
    drawn = bare.select("site", "hole", "number").join(corridors(bare, grass, spare, boundaries), "hole")
    drawn = drawn.groupBy("site", "number").agg(F.min(F.struct("hole", "outer", "holes")).alias("b")).select("site", F.lit(None).cast("long").alias("feat"), "number", F.col("b.outer").alias("shape"), "b.holes", F.lit("centerline_buffer").alias("source"))
    kept = matched.select("site", "feat", F.coalesce("matched", "hole").alias("number"), "shape", F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"), F.lit("openstreetmap").alias("source"))
    return kept.unionByName(drawn)
