"""Mapped shapes against outlines found in images: matches by overlap, outlines preferred, greens refined, trees merged.

A shape is one ring of (x: lon, y: lat) that does not cross itself; ids are unique longs and their order is the order of passes. Rows with
a null id or site and shapes of fewer than three points meet nothing. Areas are compared on a grid of 1e-7 degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import metric, rings
from sitelens.operators import areas, matching, overlay, spatial
from sitelens.operators.fusion import MAPPED, metres_to, near_shapes
from sitelens.operators.numbering import number
from sitelens.sources.scratch import materialize

# Least score of a match, share of an added shape that mapped ones may cover, layers that images may add to.
MATCH, COVERED, ADDED = 0.22, 0.15, ("bunker", "water")
# Fixed values in metres: reach from an outline's pin to another's, from a seed to an outline, from a green to its pin and to the nearest
# one, from a refined green to its pin, to other pins, from a pin to a green that is the same object, between middles; trees apart.
SAME_PIN, SEED, HIT, NEAREST, HELD, OTHERS, CLOSE, MIDDLES, TREES = 14.0, 20.0, 6.0, 28.0, 8.0, 4.0, 10.0, 16.0, 8.0
# Areas of a green in square metres, least compactness, overlaps of the same object, growth that is still taken; width of
# the rim around an outline, of smoothing in metres, share of area that a clip must keep and gain by smoothing, deviation in degrees.
GREEN_M2, COMPACT, SAME_IOU, SAME_PART, GROWTH = (90.0, 1800.0), 0.5, 0.18, 0.3, 1.1
RIM, SMOOTH, KEEPS, GAINS, DEVIATION = 3.0, 0.6, 0.55, 1.18, 0.000004
#: Grid units of a degree, grid units of a web-map metre, cell of the join by boxes in degrees.
GRID, FINE, CELL = 1e7, 100.0, 0.002


def grid_area(ring: Column) -> Column:
    return rings.signed_area(rings.from_first(ring))


def compactness(shape: Column) -> Column:
    return rings.compactness(rings.from_first(shape))


def meeting(a: DataFrame, b: DataFrame, keys: list[str], pad: float = 0.0) -> DataFrame:
    """Pairs of a(keys, shape, ...) and b(keys, shape, ...) of equal keys whose boxes, a's widened by pad degrees, meet; columns get
    the prefixes a_ and b_.

    Shapes are listed in the cells that their boxes touch and compared in the first cell that both touch, so a pair comes once. The lists
    are never broadcast: Spark judges them by the shapes before they are listed, and a wide shape fills very many cells."""
    at = lambda c: F.floor(c / F.lit(CELL)).cast("long")

    def listed(df: DataFrame, p: str, by: float) -> DataFrame:
        d = df.where(F.size("shape") > 0).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys], rings.bounds(F.col("shape")).alias("_b"))
        sides = {"w": F.col("_b.west") - by, "s": F.col("_b.south") - by, "e": F.col("_b.east") + by, "n": F.col("_b.north") + by}
        d = d.select("*", *[v.alias(f"_{p}{k}") for k, v in sides.items()]).drop("_b")
        return d.withColumn("_x", F.explode(F.sequence(at(F.col(f"_{p}w")), at(F.col(f"_{p}e"))))).withColumn("_y", F.explode(F.sequence(at(F.col(f"_{p}s")), at(F.col(f"_{p}n")))))

    j = listed(a, "a", pad).hint("merge").join(listed(b, "b", 0.0).hint("merge"), [*keys, "_x", "_y"])
    first = (F.col("_x") == at(F.greatest("_aw", "_bw"))) & (F.col("_y") == at(F.greatest("_as", "_bs")))
    met = (F.col("_aw") <= F.col("_be")) & (F.col("_bw") <= F.col("_ae")) & (F.col("_as") <= F.col("_bn")) & (F.col("_bs") <= F.col("_an"))
    return j.where(first & met).drop("_x", "_y", *[f"_{p}{k}" for p in "ab" for k in "wsen"])


def _ringed(df: DataFrame, shape: str) -> DataFrame:
    return df.select("key", overlay.snapped(F.col(shape), GRID).alias("ring"), F.lit(False).alias("hole"))


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, both): grid area that the union of a(key, shape) shares with that of b(key, shape), keys without any left out."""
    both = areas.combined(_ringed(a, "shape"), _ringed(b, "shape"), "intersection")
    return both.groupBy("key").agg(F.sum(grid_area(F.col("ring"))).alias("both"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, a_area, b_area, both): pairs of a(keys, id, shape) and b(keys, id, shape) that share ground, areas on the grid."""
    pairs = meeting(a.select(*keys, "id", "shape"), b.select(*keys, "id", "shape"), keys)
    pairs = materialize(pairs.withColumn("key", F.monotonically_increasing_id()), "pairs")
    both = shared(*(pairs.select("key", F.col(f"{p}_shape").alias("shape")) for p in "ab"))
    own = lambda p: F.abs(grid_area(overlay.snapped(F.col(f"{p}_shape"), GRID))).alias(f"{p}_area")
    return pairs.join(both, "key").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), own("a"), own("b"), "both")


def first_best(pairs: DataFrame, order: list[Column | str]) -> DataFrame:
    """(a, b): each a in its turn takes the best of its b that no earlier one took; order: within an a, best first, total with b."""
    turns = number(pairs, ["a", *order, "b"], "turn").select("a", "b", "turn")
    return matching.greedy_pairs(turns, "a", "b", "turn").select("a", "b")


def pegged(mapped: DataFrame, found: DataFrame) -> DataFrame:
    """(site, layer, feat, found, shape, source, decision): mapped(site, layer, feat, shape, source) stay as they are; each takes the
    found(site, layer, found, shape, agreed) that overlaps it most. Of the others those that sources agree on are added to layers that
    images may add to, unless mapped shapes cover them. decision: kept; matched, added, or layer, single, overlap (why not added)."""
    mapped, found = materialize(mapped, "mapped"), materialize(found, "found")
    m, f = mapped.withColumnRenamed("feat", "id"), found.withColumnRenamed("found", "id")
    pairs = overlaps(m, f, ["site", "layer"])
    # the shared part of the mapped shape is never smaller than that of both together, so it alone is the score
    scored = pairs.withColumn("score", F.col("both") / F.col("a_area")).where(F.col("score") >= MATCH)
    took = materialize(first_best(scored, [F.col("score").desc()]).select(F.col("b").alias("found"), F.col("a").alias("feat")), "taken")
    allowed, agreed = F.col("layer").isin(*ADDED), F.coalesce("agreed", F.lit(False))
    rest = found.join(took, "found", "left_anti")
    open_ = materialize(rest.where(allowed & agreed).select("site", "layer", F.col("found").alias("id"), "shape"), "open")
    near = materialize(meeting(open_, mapped.select("site", "layer", "shape"), ["site", "layer"]), "near")
    both = shared(open_.select(F.col("id").alias("key"), "shape"), near.select(F.col("a_id").alias("key"), F.col("b_shape").alias("shape")))
    # overlap with all mapped ones together bounds the shared part of both wholes, so that needs no test of its own
    over = open_.join(both, F.col("id") == F.col("key")).where(F.col("both") / F.abs(grid_area(overlay.snapped(F.col("shape"), GRID))) >= COVERED)
    over = over.select(F.col("id").alias("found"), F.lit(True).alias("over"))
    decision = F.when(~F.coalesce(allowed, F.lit(False)), "layer").when(~agreed, "single").when(F.col("over"), "overlap").otherwise("added")
    none = F.lit(None).cast("long")
    left = rest.join(over, "found", "left").select("site", "layer", none.alias("feat"), "found", "shape", F.lit("imagery").alias("source"), decision.alias("decision"))
    met = found.join(took, "found").select("site", "layer", "feat", "found", "shape", F.lit("imagery").alias("source"), F.lit("matched").alias("decision"))
    kept = mapped.select("site", "layer", "feat", none.alias("found"), "shape", F.coalesce("source", F.lit(MAPPED)).alias("source"), F.lit("kept").alias("decision"))
    return kept.unionByName(met).unionByName(left)


def preferred(outlines: DataFrame, crops: DataFrame, reach: float = SAME_PIN) -> DataFrame:
    """crops(site, outline, lon, lat, ...) with the outline (replaces) of the other list that each stands for, and what is left of that
    list: outlines in turn each give way to the nearest crop of a pin closer than reach that no earlier one took."""
    outlines, crops = materialize(outlines, "outlines"), materialize(crops, "crops")
    a = outlines.where("lon IS NOT NULL AND lat IS NOT NULL").select("site", F.col("outline").alias("a"), "lon", "lat")
    b = crops.where("lon IS NOT NULL AND lat IS NOT NULL").select("site", F.col("outline").alias("b"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    near = spatial.near(a, b, reach / metric.METRES, ["site"]).where(F.sqrt("d2") * metric.METRES < reach)
    took = materialize(first_best(near, ["d2"]), "taken")
    from_crops = crops.join(took.select(F.col("b").alias("outline"), F.col("a").alias("replaces")), "outline", "left")
    kept = outlines.join(took.select(F.col("a").alias("outline")), "outline", "left_anti").withColumn("replaces", F.lit(None).cast("long"))
    return from_crops.withColumn("origin", F.lit("crop")).unionByName(kept.withColumn("origin", F.lit("mosaic")))


def merged_trees(mapped: DataFrame, found: DataFrame, apart: float = TREES) -> DataFrame:
    """found(site, tree, lon, lat, ...) that stay beside mapped(site, lon, lat): none closer than apart to a mapped tree, nor to one
    found before that stays."""
    deg = apart / metric.METRES
    near = lambda a, b: spatial.near(a, b, deg, ["site"]).where(F.sqrt("d2") * metric.METRES < apart)
    place = [F.col("lon").alias("rlon"), F.col("lat").alias("rlat")]
    f = found.where("lon IS NOT NULL AND lat IS NOT NULL")
    old = near(f.select("site", "tree", "lon", "lat"), mapped.select("site", *place)).select("tree").distinct()
    new = materialize(f.join(old, "tree", "left_anti"), "trees")
    ids = new.select("site", F.col("tree").alias("a"), "lon", "lat")
    pairs = near(ids, new.select("site", F.col("tree").alias("b"), *place)).where("a < b").select("a", "b")
    return new.join(matching.kept_apart(new.select(F.col("tree").alias("id")), pairs).withColumnRenamed("id", "tree"), "tree", "left_semi")


def refine_choices(greens: DataFrame, outlines: DataFrame, pins: DataFrame) -> DataFrame:
    """greens(site, feat, shape) with what to do about each: decision shared (two pins), none (no outline), gate (not the same object,
    or no green), refined (the outline takes its place), grown (it is larger: the green is moved onto it); and the pin, its place, the
    outline(site, outline, lon, lat, shape: of the pin that it grew from) and its shape as refined.

    pins(site, pin, lon, lat). A green's pin is the one in or at it, else the nearest; the outline is that of the nearest pin to it."""
    greens = materialize(greens.select("site", "feat", "shape"), "greens")
    pins = materialize(pins.where(metric.valid(F.col("lon"), F.col("lat"))).select("site", "pin", "lon", "lat"), "pins")
    as_area = lambda df: df.withColumn("area", F.lit(True))
    near = near_shapes(as_area(greens), pins, NEAREST).where(F.col("metres") < NEAREST).withColumn("hit", F.col("metres") < HIT)
    away = F.when(F.col("hit"), 0.0).otherwise(F.col("metres"))
    seeds = near.groupBy("site", "feat").agg(F.count_if("hit").alias("hits"), F.min(F.struct(away.alias("away"), "pin", "lon", "lat")).alias("s"))
    seeds = materialize(seeds.select("site", "feat", "hits", "s.pin", "s.lon", "s.lat"), "seeds")
    o = outlines.where(F.size("shape") > 2).select("site", "outline", F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.col("shape").alias("refined"))
    own = spatial.near(seeds.where("hits < 2"), o.drop("refined"), SEED / metric.METRES, ["site"]).where(F.sqrt("d2") * metric.METRES < SEED)
    own = own.groupBy("feat").agg(F.min(F.struct("d2", "outline")).alias("b")).select("feat", "b.outline")
    all_ = greens.join(seeds.drop("site"), "feat", "left").join(own, "feat", "left").join(o.select("outline", "refined"), "outline", "left")
    rows = materialize(all_, "choices")
    with_outline = rows.where("outline IS NOT NULL")
    both = shared(*(with_outline.select(F.col("feat").alias("key"), F.col(c).alias("shape")) for c in ("shape", "refined"))).withColumnRenamed("key", "feat")
    others = near_shapes(as_area(with_outline.select("site", "feat", F.col("refined").alias("shape"))), pins.withColumnRenamed("pin", "_pin"), OTHERS).where(F.col("metres") < OTHERS)
    others = others.join(with_outline.select("feat", "pin"), "feat").where("_pin <> pin").select("feat", F.lit(True).alias("taken")).distinct()
    size = lambda c: F.abs(grid_area(overlay.snapped(F.col(c), GRID)))
    at = lambda c: metres_to(F.col(c), F.lit(True), F.col("lon"), F.col("lat"))
    r = rows.join(both, "feat", "left").join(others, "feat", "left").withColumns({"_a": size("shape"), "_b": size("refined"), "both": F.coalesce("both", F.lit(0.0))})
    middle = {c: _middle(F.col(c)) for c in ("shape", "refined")}
    same = (F.col("both") / (F.col("_a") + F.col("_b") - F.col("both")) >= SAME_IOU) | (F.col("both") / F.col("_b") >= SAME_PART) | (F.col("both") / F.col("_a") >= SAME_PART)
    same |= (metric.distance(middle["shape"].x, middle["shape"].y, middle["refined"].x, middle["refined"].y) < MIDDLES) & (at("shape") < CLOSE)
    new, old = metric.ellipsoid_area(F.col("refined")), metric.ellipsoid_area(F.col("shape"))
    fine = F.coalesce(same & (at("refined") < HELD) & F.col("taken").isNull() & new.between(*GREEN_M2) & (compactness(F.col("refined")) >= COMPACT), F.lit(False))
    decision = F.when(F.col("hits") > 1, "shared").when(F.col("outline").isNull(), "none").when(~fine, "gate").when((old > 0) & (new <= old * GROWTH), "refined").otherwise("grown")
    return r.select("site", "feat", "shape", "pin", "lon", "lat", "outline", "refined", decision.alias("decision"))


def _middle(shape: Column) -> Column:
    """Centroid of a ring in its own coordinates."""
    return rings.once(F.struct(shape.alias("r"), rings.centroid(rings.from_first(shape)).alias("c")), lambda s: F.struct((s.r[0].x + s.c.x).alias("x"), (s.r[0].y + s.c.y).alias("y")))


def moved_onto(grown: DataFrame) -> DataFrame:
    """(feat, shape): greens (feat, shape, refined, lon, lat) moved to the middle of a larger outline and clipped to a rim around it.

    Those that would move too far, lose their pin or come out too small or ragged are left out; the clip stays only where it keeps the
    pin and enough ground. The result is closed, then simplified, each only where the pin stays."""
    held = lambda c, reach: metres_to(F.col(c), F.lit(True), F.col("lon"), F.col("lat")) < reach
    a, b = _middle(F.col("shape")), _middle(F.col("refined"))
    north = (b.y - a.y) * metric.METRES
    east = (b.x - a.x) * metric.METRES * F.cos(F.radians(a.y))
    dx = east / (F.lit(metric.METRES) * F.greatest(F.lit(0.2), F.cos(F.radians(a.y))))
    g = grown.select("*", dx.alias("dx"), (b.y - a.y).alias("dy"), F.hypot(east, north).alias("far")).where(F.col("far") <= MIDDLES)
    g = g.withColumn("moved", F.transform("shape", lambda p: F.struct((p.x + F.col("dx")).alias("x"), (p.y + F.col("dy")).alias("y"))))
    g = materialize(g.withColumn("moved", F.when(held("moved", HELD), F.col("moved")).otherwise(F.col("shape"))).select("feat", "moved", "refined", "lon", "lat"), "moved")
    on = lambda c: g.select(F.col("feat").alias("key"), areas.mercator(F.col(c), FINE).alias("ring"), F.lit(False).alias("hole"))
    rim = areas.buffered(on("refined"), RIM * FINE).withColumn("hole", rings.signed_area(rings.from_first(F.col("ring"))) < 0)
    clipped = _nearest_part(areas.combined(on("moved"), rim, "intersection"), g)
    c = g.join(clipped, "feat", "left").withColumn("keeps", held("part", HELD) & (metric.ellipsoid_area(F.col("part")) >= metric.ellipsoid_area(F.col("moved")) * KEEPS))
    c = c.withColumn("shape", F.when(F.col("keeps"), F.col("part")).when(held("moved", HELD), F.col("moved"))).where("shape IS NOT NULL")
    c = materialize(c.select("feat", "shape", "lon", "lat"), "clipped")
    ring = areas.mercator(F.col("shape"), FINE)
    out = areas.buffered(c.select(F.col("feat").alias("key"), ring.alias("ring"), F.lit(False).alias("hole")), SMOOTH * FINE)
    back = areas.buffered(out.withColumn("hole", rings.signed_area(rings.from_first(F.col("ring"))) < 0), -SMOOTH * FINE)
    s = c.join(_nearest_part(back, c), "feat", "left")
    gains = held("part", HIT) & (metric.ellipsoid_area(F.col("part")) <= metric.ellipsoid_area(F.col("shape")) * GAINS)
    s = materialize(s.withColumn("shape", F.when(gains, F.col("part")).otherwise(F.col("shape"))).drop("part"), "smoothed")
    thin = areas.simplified(s.select(F.col("feat").alias("key"), overlay.snapped(F.col("shape"), GRID).alias("ring")), DEVIATION * GRID)
    s = s.join(thin.select(F.col("key").alias("feat"), overlay.unsnapped(F.col("ring"), GRID).alias("thin")), "feat", "left")
    s = s.withColumn("shape", F.when(held("thin", HIT), F.col("thin")).otherwise(F.col("shape")))
    return s.where((metric.ellipsoid_area(F.col("shape")) >= GREEN_M2[0]) & (compactness(F.col("shape")) >= COMPACT)).select("feat", "shape")


def _nearest_part(result: DataFrame, pins: DataFrame) -> DataFrame:
    """(feat, part): of each key's outer rings that are large enough for a green the one nearest to its pin, ties to the larger."""
    outer = result.where(rings.signed_area(rings.from_first(F.col("ring"))) > 0).select(F.col("key").alias("feat"), areas.lonlat(F.col("ring"), FINE).alias("part"))
    outer = outer.withColumn("m2", metric.ellipsoid_area(F.col("part"))).where(F.col("m2") >= GREEN_M2[0])
    away = metres_to(F.col("part"), F.lit(True), F.col("lon"), F.col("lat"))
    return outer.join(pins.select("feat", "lon", "lat"), "feat").groupBy("feat").agg(F.min(F.struct(away.alias("away"), (-F.col("m2")).alias("less"), "part")).alias("b")).select("feat", "b.part")


def refined_greens(greens: DataFrame, outlines: DataFrame, pins: DataFrame) -> DataFrame:
    """(site, feat, shape, decision, mapped_m2, refined_m2): mapped greens with the ring of their pin's outline where that is safe, or
    moved onto it where it is larger (decision moved; where that fails, gate); others keep theirs."""
    choices = materialize(refine_choices(greens, outlines, pins), "choices")
    moved = moved_onto(choices.where("decision = 'grown'")).select("feat", F.col("shape").alias("moved"))
    r = choices.join(moved, "feat", "left")
    new = F.when(F.col("decision") == "refined", F.col("refined")).otherwise(F.col("moved"))
    decision = F.when(F.col("decision") != "grown", F.col("decision")).when(F.col("moved").isNotNull(), "moved").otherwise("gate")
    return r.select("site", "feat", F.coalesce(new, F.col("shape")).alias("shape"), decision.alias("decision"), metric.ellipsoid_area(F.col("shape")).alias("mapped_m2"), metric.ellipsoid_area(new).alias("refined_m2"))
