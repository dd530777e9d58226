"""A site's mapped layers fused with points given for its holes: pins, greens, tees, lines, and the area that counts.

Rows: features(site, layer, feat, shape, area, hole, source) with shape a list of (x: lon, y: lat) and area whether it is a ring;
points(site, point, kind, hole, lon, lat), in the order of point; cards(site, pars, indexes). feat and point are unique. Sites without
a valid point keep their layers as they are. A hole that is null or 0 is none. Features with a null or empty shape match nothing."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import metric, rings
from sitelens.operators import matching, shapes
from sitelens.operators.numbering import number
from sitelens.sources.scratch import materialize

# Reach of a pin to its green and of a point to its tee, half width of an added tee, margin around given points, all in
# metres; source of features that name none.
GREEN_REACH, TEE_REACH, TEE_HALF, MARGIN, MAPPED = 45.0, 38.0, 7.0, 130.0, "openstreetmap"
#: Columns of a fused feature.
OUT = ["site", "layer", "feat", "point", "shape", "hole", "given_hole", "par", "stroke_index", "source", "geom_source"]


def valid_points(points: DataFrame) -> DataFrame:
    hole = F.when(F.col("hole") != 0, F.col("hole").cast("long"))
    return points.where(metric.valid(F.col("lon"), F.col("lat"))).select("site", "point", "kind", hole.alias("hole"), "lon", "lat")


def chosen_pins(points: DataFrame) -> DataFrame:
    """(site, turn, point, kind, hole, lon, lat): of each hole the last pin, else the last green; of sites without numbered ones all
    greens, then all pins. turn orders a site's pins."""
    p = valid_points(points).where("kind IN ('green', 'pin')").withColumn("late", F.col("kind") == "pin")
    own = p.where("hole IS NOT NULL").groupBy("site", "hole").agg(F.max(F.struct("late", "point", "kind", "lon", "lat")).alias("p"))
    own = own.select("site", F.struct(F.col("hole").alias("a"), F.lit(0).cast("long").alias("b")).alias("turn"), "p.point", "p.kind", "hole", "p.lon", "p.lat")
    rest = p.join(own.select("site").distinct(), "site", "left_anti")
    return own.unionByName(rest.select("site", F.struct(F.col("late").cast("long").alias("a"), F.col("point").cast("long").alias("b")).alias("turn"), "point", "kind", "hole", "lon", "lat"))


def metres_to(shape: Column, area: Column, lon: Column, lat: Column) -> Column:
    """Distance of a point to a shape, 0 within a ring; NULL for none."""
    edges = rings._edges(shape)
    edges = F.when(area | (F.size(shape) < 2), edges).otherwise(F.slice(edges, 1, F.greatest(F.size(shape) - 1, F.lit(1))))
    away = F.array_min(F.transform(edges, lambda e: metric.to_segment(lon, lat, e.a.x, e.a.y, e.b.x, e.b.y)))
    return F.when(F.size(shape) > 0, F.when(area & rings.contains(shape, lon, lat), F.lit(0.0)).otherwise(away))


def near_shapes(feats: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """Pairs of feats(site, feat, shape, area) and points(site, lon, lat, ...) of a site within reach metres, with metres.

    A feature is listed in the cells that its widened box touches, a point lies in one, so a pair comes once and only near ones are
    compared, however many rows a site has."""
    deg = reach / metric.METRES
    cell = lambda c: F.floor(c / F.lit(4 * deg)).cast("long")
    f = feats.where(F.size("shape") > 0).select("site", "feat", "shape", F.coalesce("area", F.lit(False)).alias("area"), rings.bounds(F.col("shape")).alias("_b"))
    f = f.withColumn("_x", F.explode(F.sequence(cell(F.col("_b.west") - deg), cell(F.col("_b.east") + deg)))).withColumn("_y", F.explode(F.sequence(cell(F.col("_b.south") - deg), cell(F.col("_b.north") + deg))))
    j = f.join(points.withColumns({"_x": cell(F.col("lon")), "_y": cell(F.col("lat"))}), ["site", "_x", "_y"]).drop("_x", "_y", "_b")
    return j.withColumn("metres", metres_to(F.col("shape"), F.col("area"), F.col("lon"), F.col("lat"))).where(F.col("metres") <= reach).drop("shape", "area")


def _out(df: DataFrame, layer: str | None = None, **columns: Column) -> DataFrame:
    """df with the columns of a fused feature; those it lacks are NULL."""
    types = {"point": "long", "hole": "long", "given_hole": "long", "par": "int", "stroke_index": "int", "feat": "long", "source": "string", "geom_source": "string"}
    have = {c: F.col(c) for c in df.columns} | ({"layer": F.lit(layer)} if layer else {}) | columns
    return df.select(*[(have[c].cast(types[c]) if c in have and c in types else have[c] if c in have else F.lit(None).cast(types[c])).alias(c) for c in OUT])


def _dot(lon: Column, lat: Column) -> Column:
    return F.array(F.struct(lon.alias("x"), lat.alias("y")))


def fused_pins(feats: DataFrame, points: DataFrame, source: str) -> DataFrame:
    """Given pins take the place of a site's mapped ones; without any, mapped ones with a shape stay."""
    pins = chosen_pins(points)
    given = _out(pins, "pin", shape=_dot(F.col("lon"), F.col("lat")), source=F.lit(source))
    kept = feats.where("layer = 'pin'").join(pins.select("site").distinct(), "site", "left_anti").where(F.size("shape") > 0)
    return given.unionByName(_out(kept, source=F.coalesce("source", F.lit(MAPPED))))


def fused_greens(feats: DataFrame, points: DataFrame, reach: float = GREEN_REACH) -> DataFrame:
    """Greens with the hole of their nearest pin closer than reach, ties to the pin first in turn. Of sites that have pins, greens
    without a hole, their own or a pin's, go."""
    pins, greens = materialize(chosen_pins(points), "pins"), feats.where("layer = 'green'")
    near = near_shapes(greens, pins, reach).where(F.col("metres") < reach)
    best = near.groupBy("feat").agg(F.min(F.struct("metres", "turn", "hole")).alias("b")).select("feat", F.col("b.hole").alias("_given"))
    sites = pins.select("site", F.lit(True).alias("_pinned")).distinct()
    g = greens.join(best, "feat", "left").join(sites, "site", "left").withColumn("hole", F.coalesce("_given", F.when(F.col("hole") != 0, F.col("hole"))))
    return _out(g.where("_pinned IS NULL OR hole IS NOT NULL"), given_hole=F.col("_given"))


def fused_tees(feats: DataFrame, points: DataFrame, source: str, reach: float = TEE_REACH, half: float = TEE_HALF) -> DataFrame:
    """Given tees in their order each take the first mapped one, in its order, within reach that no earlier one took; others are added
    as circles. Mapped tees of these sites that none took go."""
    given = materialize(valid_points(points).where("kind = 'tee'"), "given")
    tees = feats.where("layer = 'tee'")
    took = matching.first_unused(near_shapes(tees, given, reach).select("point", "feat"), "point", "feat")
    met = given.select("site", "point", F.col("hole").alias("_given"), "lon", "lat").join(took, "point", "left")
    of = tees.select("feat", "shape", "hole", F.col("source").alias("_source"))
    met = met.join(of, "feat", "left").withColumn("_new", F.col("feat").isNull())
    circle = metric.capsule(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat"), half)
    found = _out(
        met, "tee", shape=F.when(F.col("_new"), circle).otherwise(F.col("shape")), hole=F.coalesce("_given", "hole"), given_hole=F.when(~F.col("_new"), F.col("_given")),
        source=F.lit(source), geom_source=F.when(~F.col("_new"), F.coalesce("_source", F.lit(MAPPED))),
    )
    return found.unionByName(_out(tees.join(given.select("site").distinct(), "site", "left_anti")))


def given_lines(points: DataFrame, source: str) -> DataFrame:
    """A line for each numbered pin from the hole's farthest tee (ties: the first) over its bends, by their distance to the tee;
    holes without a tee away from the pin have none."""
    pins = chosen_pins(points).where("hole IS NOT NULL").select("site", "hole", F.col("lon").alias("px"), F.col("lat").alias("py"))
    v = valid_points(points)
    away = F.hypot(F.col("lon") - F.col("px"), F.col("lat") - F.col("py"))
    t = v.where("kind = 'tee'").join(pins, ["site", "hole"]).groupBy("site", "hole", "px", "py")
    t = t.agg(F.max(F.struct(away.alias("d"), (-F.col("point")).alias("order"), "lon", "lat")).alias("t")).where("t.d > 0").select("site", "hole", "px", "py", F.col("t.lon").alias("tx"), F.col("t.lat").alias("ty"))
    from_tee, to_pin = F.hypot(F.col("lon") - F.col("tx"), F.col("lat") - F.col("ty")), F.hypot(F.col("lon") - F.col("px"), F.col("lat") - F.col("py"))
    bends = v.where("kind = 'dogleg'").join(t, ["site", "hole"]).where((from_tee >= 1e-7) & (to_pin >= 1e-7))
    bends = bends.groupBy("site", "hole").agg(F.array_sort(F.collect_list(F.struct(from_tee.alias("d"), "point", "lon", "lat"))).alias("bends"))
    line = t.join(bends, ["site", "hole"], "left")
    over = F.coalesce(F.transform("bends", lambda b: F.struct(b.lon.alias("x"), b.lat.alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    return _out(line, "hole_centerline", shape=F.concat(_dot(F.col("tx"), F.col("ty")), over, _dot(F.col("px"), F.col("py"))), source=F.lit(source))


def _in_turn(frame: pd.DataFrame) -> pd.DataFrame:
    used, out = set(), []
    for feat, wishes in frame.sort_values("_turn")[["feat", "wishes"]].itertuples(index=False):
        hole = next((h for h in wishes if h not in used), wishes[0])
        used.add(hole)
        out.append((feat, hole))
    return pd.DataFrame(out, columns=["feat", "_given"])


def stamped_lines(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Mapped lines of sites with numbered pins, in the order of feat, each with the hole of the pin nearest to one of its ends (ties:
    the smaller hole) whose hole no earlier line has; once all are taken, of the nearest pin.

    As many lines as the site has holes take them all, so only these depend on each other: they are one small group; every other line
    is settled by itself."""
    pins = chosen_pins(points).where("hole IS NOT NULL")
    pins = pins.groupBy("site").agg(F.collect_list(F.struct("hole", "lon", "lat")).alias("pins"))
    fit = lines.where((F.size("shape") > 1) & ~F.coalesce("area", F.lit(False))).join(pins, "site")
    ends = [F.element_at("shape", 1), F.element_at("shape", -1)]
    nearest = lambda p: F.least(*[metric.distance(p.lon, p.lat, e.x, e.y) for e in ends])
    wishes = F.transform(F.array_sort(F.transform("pins", lambda p: F.struct(nearest(p).alias("d"), p.hole.alias("hole")))), lambda w: w.hole)
    placed = materialize(number(fit.select("site", "feat", wishes.alias("wishes")), ["feat"], "_turn", "site"), "wishes")
    first = placed.where(F.col("_turn") <= F.size("wishes")).groupBy("site").applyInPandas(_in_turn, "feat long, _given long")
    rest = placed.where(F.col("_turn") > F.size("wishes")).select("feat", F.element_at("wishes", 1).alias("_given"))
    return lines.join(first.unionByName(rest), "feat", "left").withColumn("hole", F.coalesce("_given", "hole"))


def with_card(lines: DataFrame, cards: DataFrame) -> DataFrame:
    """Lines with par and stroke index of their given hole; holes beyond the card keep what they have."""
    c = cards.dropDuplicates(["site"]).select("site", "pars", "indexes")
    j = lines.join(c, "site", "left")
    at = F.when(F.col("_on_card") >= 1, F.col("_on_card")).cast("int")
    j = j.withColumns({"par": F.coalesce(F.try_element_at("pars", at), "par"), "stroke_index": F.coalesce(F.try_element_at("indexes", at), "stroke_index")})
    return j.select(*OUT)


def fused_lines(feats: DataFrame, points: DataFrame, cards: DataFrame, source: str) -> DataFrame:
    """Lines from given tees and pins take the place of a site's mapped ones; without any, mapped ones are stamped. Cards give par."""
    points = points.where("kind IN ('green', 'pin', 'tee', 'dogleg')")
    given = materialize(given_lines(points, source), "given")
    mapped = feats.where("layer = 'hole_centerline'").join(given.select("site").distinct(), "site", "left_anti")
    # only sites with points are touched
    met = valid_points(points).select("site", F.lit(True).alias("_met")).distinct()
    s = stamped_lines(mapped, points).join(met, "site", "left")
    stamped = _out(s, given_hole=F.col("_given"), source=F.coalesce("source", F.when(F.col("_met") & (F.size("shape") > 1), F.lit(MAPPED))))
    both = given.withColumn("_on_card", F.col("hole")).unionByName(stamped.withColumn("_on_card", F.col("given_hole")))
    return with_card(both, cards)


def fused(feats: DataFrame, points: DataFrame, cards: DataFrame, source: str = "catalog", green_reach: float = GREEN_REACH, tee_reach: float = TEE_REACH) -> DataFrame:
    """All layers of all sites after fusion; layers other than pins, greens, tees and lines stay as they are."""
    feats, points = materialize(feats, "features"), materialize(points, "points")
    same = _out(feats.where("layer NOT IN ('pin', 'green', 'tee', 'hole_centerline') OR layer IS NULL"))
    parts = [fused_pins(feats, points, source), fused_greens(feats, points, green_reach), fused_tees(feats, points, source, tee_reach), fused_lines(feats, points, cards, source), same]
    return reduce(DataFrame.unionByName, parts)


def clips(points: DataFrame, boundaries: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(site, origin, ring): what counts as the site: the hull of its given points with a margin, else its boundary(site, ring).

    A hull with a margin is the hull of circles around its corners, so points are reduced to corners first."""
    v = valid_points(points).select(F.col("site").alias("key"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    corners = shapes.hulls(v).select("key", F.explode("ring").alias("p"))
    around = corners.select("key", F.explode(metric.capsule(F.col("p.x"), F.col("p.y"), F.col("p.x"), F.col("p.y"), margin)).alias("q")).select("key", "q.x", "q.y")
    given = shapes.hulls(around).select(F.col("key").alias("site"), F.lit("given").alias("origin"), "ring")
    rest = boundaries.where(F.size("ring") > 2).join(given.select("site"), "site", "left_anti")
    return given.unionByName(rest.select("site", F.lit("mapped").alias("origin"), "ring"))
