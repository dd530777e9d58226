"""Queries on mapped shapes against outlines found in images, and their SQL: shapes are Ls on a grid of 1e-7 degrees, two boxes each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import metric
from sitelens.operators import filling, fusion, refinement, spatial
from sitelens.sources.scratch import materialize
from sitelens.sources.tables import features, sites

LAYERS = {"green": "green", "bunker": "bunker", "lateral_water_hazard": "water", "rough": "bunker"}


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, k, n (k / 12), golf, layer and place (x, y), width and height (in grid units) of features that belong to a site."""
    f = features(spark, sf_dir).where(F.col("golf").isin(*LAYERS, "hole")).select("feat", "lon", "lat", "golf")
    units = lambda c: F.round(F.col(c) * refinement.GRID).cast("long")
    k, layer = F.col("feat"), F.create_map(*[F.lit(v) for kv in LAYERS.items() for v in kv])[F.col("golf")]
    size = {"w": 3000 + k % 7 * 200, "h": 2600 + k % 5 * 300}
    placed = spatial.assign_to_sites(f, sites(spark, sf_dir))
    # read several times by each query
    placed = placed.select("site", k.alias("k"), F.floor(k / 12).alias("n"), "golf", layer.alias("layer"), units("lon").alias("x"), units("lat").alias("y"), *[v.alias(c) for c, v in size.items()])
    return materialize(placed, "placed")


def _ell(x: Column, y: Column, w: Column, h: Column) -> Column:
    half = lambda c: F.floor(c / 2)
    points = ((x, y), (x + w, y), (x + w, y + half(h)), (x + half(w), y + half(h)), (x + half(w), y + h), (x, y + h))
    return F.array(*[_at(a, b) for a, b in points])


def _at(x: Column, y: Column) -> Column:
    return F.struct((x / refinement.GRID).alias("x"), (y / refinement.GRID).alias("y"))


def _mapped(placed: DataFrame) -> DataFrame:
    m = placed.where(F.col("golf").isin("green", "bunker", "lateral_water_hazard"))
    return m.select("site", "layer", F.col("k").alias("feat"), _ell(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("shape"), F.lit(None).cast("string").alias("source"), "n")


def _id() -> Column:
    return F.col("k") * 2 + F.when(F.col("t") == 1, 0).otherwise(1)


def _found(placed: DataFrame) -> DataFrame:
    """An outline for four of five features, moved and of another width, a second one for every third."""
    f = placed.where(F.col("golf").isin(*LAYERS)).withColumn("t", F.explode(F.array(F.lit(1), F.lit(-1)))).where("(t = 1 AND k % 5 < 4) OR (t = -1 AND n % 3 = 0)")
    x, y = F.col("x") + (F.col("n") * 37 % 61 - 30) * 60 * F.col("t"), F.col("y") + (F.col("n") * 53 % 67 - 33) * 60
    shape = _ell(x, y, F.col("w") + (F.col("n") % 3 - 1) * 600, F.col("h"))
    return f.select("site", "layer", _id().alias("found"), shape.alias("shape"), (F.col("n") % 2 == 0).alias("agreed"), "golf", "n", "t", *_pin(F.lit(0), (F.col("n") % 11 - 5) * 300 + F.col("t") * 7 + 3))


def _pin(dx: Column, dy: Column) -> list[Column]:
    """Place of the pin of a feature's shape, moved."""
    x, y = F.col("x") + F.floor(F.col("w") / 4) + (F.col("n") * 7 % 9 - 4) * 400 + dx, F.col("y") + F.floor(F.col("h") / 4) + dy
    return [(x / refinement.GRID).alias("lon"), (y / refinement.GRID).alias("lat")]


def _pins(placed: DataFrame) -> DataFrame:
    p = placed.where("golf = 'green'").withColumn("t", F.explode(F.array(F.lit(1), F.lit(-1)))).where("t = 1 OR n % 6 = 0")
    return p.select("site", _id().alias("pin"), *_pin(F.when(F.col("t") == 1, 0).otherwise(700), F.lit(0)))


def _outlines(placed: DataFrame) -> DataFrame:
    return _found(placed).where("golf = 'green'").select("site", F.col("found").alias("outline"), "lon", "lat", "shape", "t")


def pegged_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every mapped shape and of every outline found: kept, matched, added or why not."""
    placed = _placed(spark, sf_dir)
    out = refinement.pegged(_mapped(placed).drop("n"), _found(placed).select("site", "layer", "found", "shape", "agreed"))
    return out.select("site", "layer", "feat", "found", "source", "decision")


def preferred_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of two lists, the second's standing for the first's of the same pin."""
    o = _outlines(_placed(spark, sf_dir))
    out = refinement.preferred(o.where("t = 1").drop("t"), o.where("t = -1").drop("t"))
    return out.select("site", "outline", "replaces", "origin")


def merged_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees found at corners of shapes that stay beside mapped ones (the first corners of greens) and those found before."""
    placed = _placed(spark, sf_dir)
    f = _found(placed).select("site", "found", F.posexplode("shape").alias("i", "p"))
    mapped = _mapped(placed).where("layer = 'green'").select("site", F.col("shape")[0].x.alias("lon"), F.col("shape")[0].y.alias("lat"))
    out = refinement.merged_trees(mapped, f.select("site", (F.col("found") * 6 + F.col("i")).alias("tree"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat")))
    return out.select("site", "tree")


def green_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done about each mapped green, with its pin and that pin's outline."""
    placed = _placed(spark, sf_dir)
    greens = _mapped(placed).where("layer = 'green'").select("site", "feat", "shape")
    return refinement.refine_choices(greens, _outlines(placed).drop("t"), _pins(placed)).select("site", "feat", "pin", "outline", "decision")


def refined_greens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greens after refinement: square metres before and after."""
    placed = _placed(spark, sf_dir)
    greens = _mapped(placed).where("layer = 'green'").select("site", "feat", "shape")
    out = refinement.refined_greens(greens, _outlines(placed).drop("t"), _pins(placed))
    return out.select("site", "feat", "decision", F.round("mapped_m2", 1).alias("mapped_m2"), F.round("refined_m2", 1).alias("refined_m2"))


def filled_greens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes without a green and the outline that fills them; two of three greens are mapped, one of them has its hole."""
    placed = _placed(spark, sf_dir)
    greens = _mapped(placed).where("layer = 'green' AND n % 3 <> 1").select("site", "shape")
    pinned = lambda c: F.when(F.col("n") % 7 != 1, c)
    lon, lat = _pin(F.lit(0), F.lit(0))
    holes = placed.where("golf = 'green'").select("site", F.col("k").alias("hole"), (F.col("n") % 18 + 1).alias("number"), F.when(F.col("n") % 3 == 0, F.col("k")).alias("green"), pinned(lon).alias("lon"), pinned(lat).alias("lat"))
    return filling.filled_greens(holes, _outlines(placed).drop("t"), greens).select("site", "hole", "number", "outline", "decision")


def fairway_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fairways with the number of their hole, and the holes for which a corridor is drawn."""
    placed = _placed(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    lines = placed.where("golf = 'hole'")
    holes = lines.select("site", F.col("k").alias("hole"), (F.col("n") % 9 + 1).alias("number"), F.array(_at(x, y), _at(x + (F.col("n") % 5 - 2) * 12000, y + (F.col("n") % 4 - 1) * 9000 + 5000)).alias("line"))
    fx, fy = x + (F.col("n") % 5 - 2) * 6000 + (F.col("n") * 41 % 91 - 45) * 100, y + (F.col("n") * 29 % 97 - 48) * 100
    fairways = lines.where("n % 3 < 2").select("site", F.col("k").alias("feat"), _ell(fx, fy, F.lit(4000), F.lit(6000)).alias("shape"), (F.col("n") % 11 + 1).alias("hole"))
    square = lambda pad: F.array(_at(x - pad, y - pad), _at(x + pad, y - pad), _at(x + pad, y + pad), _at(x - pad, y + pad))
    grass = lines.where("site % 2 = 0").select("site", square(8000).alias("shape"))
    spare = _mapped(placed).select("site", "shape")
    s = sites(spark, sf_dir).where("site % 3 = 0").select("site", (F.col("lon") * refinement.GRID).alias("x"), (F.col("lat") * refinement.GRID).alias("y"))
    out = filling.derived_fairways(fairways, holes, grass, spare, s.select("site", square(1000000).alias("shape")))
    return out.select("site", "feat", "number", "source")


QUERIES = {f.__name__: f for f in (pegged_layers, preferred_outlines, merged_trees, green_choices, refined_greens, filled_greens, fairway_fill)}


def oracles(assign: str) -> dict[str, str]:
    """SQL of the queries; assign: common tables up to a(feat, lon, lat, golf, site). refined_greens has none for its rims and arcs."""
    m, e = metric.METRES, math.sqrt(metric.FLAT * (2 - metric.FLAT))
    layer = "CASE golf " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYERS.items()) + " END"
    pin = lambda dx, dy: f"x + w // 4 + (n * 7 % 9 - 4) * 400 + {dx} AS px, y + h // 4 + {dy} AS py"
    # two boxes of an L, corners as (x0, y0, x1, y1)
    rects = lambda t, x, y, w, h, keep: f"SELECT {keep}, {x} AS x0, {y} AS y0, {x} + {w} AS x1, {y} + {h} // 2 AS y1 FROM {t} UNION ALL SELECT {keep}, {x}, {y} + {h} // 2, {x} + {w} // 2, {y} + {h} FROM {t}"
    common = f"""{assign.removeprefix("WITH ")},
pl AS (SELECT site, feat AS k, feat // 12 AS n, golf, round(lon * 1e7)::BIGINT AS x, round(lat * 1e7)::BIGINT AS y, 3000 + feat % 7 * 200 AS w, 2600 + feat % 5 * 300 AS h FROM a WHERE golf IN ('hole', {", ".join(f"'{k}'" for k in LAYERS)})),
ma AS (SELECT *, {layer} AS layer, k AS feat FROM pl WHERE golf IN ('green', 'bunker', 'lateral_water_hazard')),
fo AS (SELECT site, {layer} AS layer, golf, n, t, k * 2 + (1 - t) // 2 AS found, x + (n * 37 % 61 - 30) * 60 * t AS fx, y + (n * 53 % 67 - 33) * 60 AS fy, w + (n % 3 - 1) * 600 AS fw, h AS fh, n % 2 = 0 AS agreed, {pin("0", "(n % 11 - 5) * 300 + t * 7 + 3")}
  FROM pl, (VALUES (1), (-1)) v(t) WHERE golf <> 'hole' AND ((t = 1 AND k % 5 < 4) OR (t = -1 AND n % 3 = 0))),
pi AS (SELECT site, k * 2 + (1 - t) // 2 AS pin, {pin("CASE t WHEN 1 THEN 0 ELSE 700 END", "0")} FROM pl, (VALUES (1), (-1)) v(t) WHERE golf = 'green' AND (t = 1 OR n % 6 = 0)),
mr AS ({rects("ma", "x", "y", "w", "h", "site, layer, feat, n")}), fr AS ({rects("fo", "fx", "fy", "fw", "fh", "site, layer, found, t")}),
sz AS (SELECT feat AS id, sum((x1 - x0) * (y1 - y0)) AS area FROM mr GROUP BY ALL), fz AS (SELECT found AS id, sum((x1 - x0) * (y1 - y0)) AS area FROM fr GROUP BY ALL)"""
    shared = "sum((least(m.x1, f.x1) - greatest(m.x0, f.x0)) * (least(m.y1, f.y1) - greatest(m.y0, f.y0)))"
    meet = "m.site = f.site AND m.layer = f.layer AND m.x0 < f.x1 AND f.x0 < m.x1 AND m.y0 < f.y1 AND f.y0 < m.y1"
    apart = lambda ax, ay, bx, by: f"sqrt(({ax} - {bx}) ** 2 + ({ay} - {by}) ** 2) / 1e7 * {m}"
    box = lambda px, py, r: f"sqrt(greatest({r}.x0 - {px}, {px} - {r}.x1, 0) ** 2 + greatest({r}.y0 - {py}, {py} - {r}.y1, 0) ** 2) / 1e7 * {m}"
    q = lambda y: f"{1 - e * e} * (sin(radians({y} / 1e7)) / (1 - (sin(radians({y} / 1e7)) * {e}) ** 2) - {1 / (2 * e)} * ln((1 - sin(radians({y} / 1e7)) * {e}) / (1 + sin(radians({y} / 1e7)) * {e})))"
    m2 = f"sum(radians((x1 - x0) / 1e7) * ({q('y1')} - {q('y0')})) * {metric.RADIUS**2 / 2}"
    middle = "sum((x1 - x0) * (y1 - y0) * (x0 + x1) / 2.0) / sum((x1 - x0) * (y1 - y0)) AS cx, sum((x1 - x0) * (y1 - y0) * (y0 + y1) / 2.0) / sum((x1 - x0) * (y1 - y0)) AS cy"
    measured = f"gm AS (SELECT feat, {m2} AS m2, {middle} FROM mr WHERE layer = 'green' GROUP BY ALL), fm AS (SELECT found, {m2} AS m2, {middle} FROM fr WHERE layer = 'green' GROUP BY ALL)"
    # passes over (a, b) in order within a site: each is used once
    used = "(list_contains(pa.sa, o.a) OR list_contains(pa.sb, o.b))"
    passed = f"""pa AS (SELECT site, i, a, b, true AS ok, [a] AS sa, [b] AS sb FROM o WHERE i = 1
  UNION ALL SELECT o.site, o.i, o.a, o.b, NOT {used}, CASE WHEN {used} THEN pa.sa ELSE list_append(pa.sa, o.a) END, CASE WHEN {used} THEN pa.sb ELSE list_append(pa.sb, o.b) END FROM pa JOIN o ON o.site = pa.site AND o.i = pa.i + 1), took AS (SELECT a, b FROM pa WHERE ok)"""
    good = filling.GREEN_M2
    ragged = f"0.75 * fw * fh * 4 * pi() / (2 * (fw + fh)) ** 2 >= {filling.COMPACT}"
    merc = lambda v: f"ln(tan(radians({v} / 1e7) / 2 + pi() / 4)) * {metric.RADIUS}"
    flat = lambda v: f"radians({v} / 1e7) * {metric.RADIUS}"
    corners = [(x, y) for x in ("r.u0", "r.u1") for y in ("r.v0", "r.v1")]
    turn = lambda x, y: f"sign((l.bu - l.au) * ({y} - l.av) - (l.bv - l.av) * ({x} - l.au))"
    beside = lambda x, y: f"greatest(r.u0 - {x}, {x} - r.u1, 0) ** 2 + greatest(r.v0 - {y}, {y} - r.v1, 0) ** 2"
    along = lambda x, y: f"least(greatest((({x} - l.au) * (l.bu - l.au) + ({y} - l.av) * (l.bv - l.av)) / ((l.bu - l.au) ** 2 + (l.bv - l.av) ** 2), 0), 1)"
    to_line = lambda x, y: f"(l.au + {along(x, y)} * (l.bu - l.au) - {x}) ** 2 + (l.av + {along(x, y)} * (l.bv - l.av) - {y}) ** 2"
    over = f"greatest(l.au, l.bu) >= r.u0 AND least(l.au, l.bu) <= r.u1 AND greatest(l.av, l.bv) >= r.v0 AND least(l.av, l.bv) <= r.v1 AND abs({' + '.join(turn(x, y) for x, y in corners)}) < 4"
    gap = f"CASE WHEN {over} THEN 0 ELSE least({beside('l.au', 'l.av')}, {beside('l.bu', 'l.bv')}, {', '.join(to_line(x, y) for x, y in corners)}) END"
    return {
        "pegged_layers": f"""WITH RECURSIVE {common},
ov AS (SELECT m.site, m.feat, f.found, {shared} AS cut FROM mr m JOIN fr f ON {meet} GROUP BY ALL),
o AS (SELECT ov.site, feat AS a, found AS b, row_number() OVER (PARTITION BY ov.site ORDER BY feat, cut / area DESC, found) AS i FROM ov JOIN sz ON sz.id = feat WHERE cut / area >= {refinement.MATCH}), {passed},
cv AS (SELECT found, sum(cut) / any_value(area) >= {refinement.COVERED} AS covered FROM ov JOIN fz ON fz.id = found GROUP BY ALL)
SELECT site, layer, feat, NULL::BIGINT AS found, '{fusion.MAPPED}' AS source, 'kept' AS decision FROM ma
UNION ALL SELECT site, layer, took.a, fo.found, 'imagery', CASE WHEN took.a IS NOT NULL THEN 'matched' WHEN layer NOT IN {refinement.ADDED} THEN 'layer' WHEN NOT agreed THEN 'single' WHEN covered THEN 'overlap' ELSE 'added' END
FROM fo LEFT JOIN took ON took.b = fo.found LEFT JOIN cv ON cv.found = fo.found""",
        "preferred_outlines": f"""WITH RECURSIVE {common}, ol AS (FROM fo WHERE golf = 'green'),
o AS (SELECT x.site, x.found AS a, y.found AS b, row_number() OVER (PARTITION BY x.site ORDER BY x.found, (x.px - y.px) ** 2 + (x.py - y.py) ** 2, y.found) AS i FROM ol x JOIN ol y USING (site) WHERE x.t = 1 AND y.t = -1 AND {apart("x.px", "x.py", "y.px", "y.py")} < {refinement.SAME_PIN}), {passed}
SELECT site, found AS outline, took.a AS replaces, 'crop' AS origin FROM ol LEFT JOIN took ON took.b = found WHERE t = -1 UNION ALL SELECT site, found, NULL, 'mosaic' FROM ol WHERE t = 1 AND found NOT IN (SELECT a FROM took)""",
        "merged_trees": f"""WITH RECURSIVE {common},
c AS (SELECT site, found * 6 + i AS tree, fx + CASE i WHEN 1 THEN fw WHEN 2 THEN fw WHEN 3 THEN fw // 2 WHEN 4 THEN fw // 2 ELSE 0 END AS tx, fy + CASE i WHEN 2 THEN fh // 2 WHEN 3 THEN fh // 2 WHEN 4 THEN fh WHEN 5 THEN fh ELSE 0 END AS ty FROM fo, range(6) v(i)),
f AS (SELECT * FROM c WHERE NOT EXISTS (FROM ma WHERE layer = 'green' AND ma.site = c.site AND {apart("ma.x", "ma.y", "tx", "ty")} < {refinement.TREES})),
cf AS (SELECT s.tree AS late, list(r.tree) AS early FROM f r JOIN f s ON r.site = s.site AND r.tree < s.tree AND {apart("r.tx", "r.ty", "s.tx", "s.ty")} < {refinement.TREES} GROUP BY ALL),
o AS (SELECT site, tree, early, row_number() OVER (PARTITION BY site ORDER BY tree) AS i FROM f LEFT JOIN cf ON late = tree WHERE early IS NOT NULL OR tree IN (SELECT unnest(early) FROM cf)),
pa AS (SELECT site, i, tree, coalesce(len(early), 0) = 0 AS ok, [tree] AS held FROM o WHERE i = 1
  UNION ALL SELECT o.site, o.i, o.tree, NOT list_has_any(pa.held, coalesce(o.early, [])), CASE WHEN list_has_any(pa.held, coalesce(o.early, [])) THEN pa.held ELSE list_append(pa.held, o.tree) END FROM pa JOIN o ON o.site = pa.site AND o.i = pa.i + 1)
SELECT site, tree FROM f WHERE tree NOT IN (SELECT tree FROM o) UNION ALL SELECT site, tree FROM pa WHERE ok""",
        "green_choices": f"""WITH {common}, {measured},
d AS (SELECT m.site, m.feat, p.pin, px, py, min({box("px", "py", "m")}) AS away FROM mr m JOIN pi p ON p.site = m.site WHERE m.layer = 'green' GROUP BY ALL HAVING away < {refinement.NEAREST}),
se AS (SELECT site, feat, count(*) FILTER (WHERE away < {refinement.HIT}) AS hits, min({{'d': CASE WHEN away < {refinement.HIT} THEN 0 ELSE away END, 'pin': pin, 'px': px, 'py': py}}) AS s FROM d GROUP BY ALL),
ow AS (SELECT feat, min({{'d': (s.px - f.px) ** 2 + (s.py - f.py) ** 2, 'outline': found}}).outline AS outline FROM se JOIN fo f ON f.site = se.site AND f.golf = 'green' WHERE hits < 2 AND {apart("s.px", "s.py", "f.px", "f.py")} < {refinement.SEED} GROUP BY ALL),
bo AS (SELECT m.feat, f.found, {shared} AS cut FROM mr m JOIN fr f ON {meet} GROUP BY ALL),
op AS (SELECT ow.feat, p.pin, min({box("p.px", "p.py", "f")}) AS away FROM ow JOIN fr f ON f.found = outline JOIN pi p ON p.site = f.site GROUP BY ALL),
t AS (SELECT g.site, g.feat, hits, se.s.pin AS pin, outline, coalesce(cut, 0) AS cut, sz.area AS ga, fz.area AS fa, gm.m2 AS gm2, fm.m2 AS fm2, {apart("gm.cx", "gm.cy", "fm.cx", "fm.cy")} AS mid, d.away AS at_green, mine.away AS at_new,
  EXISTS (FROM op WHERE op.feat = g.feat AND op.pin <> se.s.pin AND op.away < {refinement.OTHERS}) AS taken, {ragged} AS round_enough
  FROM ma g LEFT JOIN se ON se.feat = g.feat LEFT JOIN ow ON ow.feat = g.feat LEFT JOIN bo ON bo.feat = g.feat AND bo.found = outline LEFT JOIN sz ON sz.id = g.feat LEFT JOIN fz ON fz.id = outline LEFT JOIN gm ON gm.feat = g.feat LEFT JOIN fm ON fm.found = outline
  LEFT JOIN d ON d.feat = g.feat AND d.pin = se.s.pin LEFT JOIN op mine ON mine.feat = g.feat AND mine.pin = se.s.pin LEFT JOIN fo ON fo.found = outline WHERE g.layer = 'green')
SELECT site, feat, pin, outline, CASE WHEN hits > 1 THEN 'shared' WHEN outline IS NULL THEN 'none' WHEN NOT ((cut / (ga + fa - cut) >= {refinement.SAME_IOU} OR cut / fa >= {refinement.SAME_PART} OR cut / ga >= {refinement.SAME_PART} OR (mid < {refinement.MIDDLES} AND at_green < {refinement.CLOSE}))
  AND at_new < {refinement.HELD} AND NOT taken AND fm2 BETWEEN {good[0]} AND {good[1]} AND round_enough) THEN 'gate' WHEN fm2 <= gm2 * {refinement.GROWTH} THEN 'refined' ELSE 'grown' END AS decision FROM t""",
        "filled_greens": f"""WITH {common}, {measured},
op AS (SELECT site, k AS hole, n % 18 + 1 AS number, CASE WHEN n % 7 <> 1 THEN px END AS px, py FROM (SELECT *, {pin("0", "0")} FROM pl WHERE golf = 'green' AND n % 3 <> 0)),
ow AS (SELECT hole, min({{'d': (op.px - f.px) ** 2 + (op.py - f.py) ** 2, 'outline': found}}).outline AS outline FROM op JOIN fo f ON f.site = op.site AND f.golf = 'green' WHERE {apart("op.px", "op.py", "f.px", "f.py")} < {filling.SAME_PIN} GROUP BY ALL),
aw AS (SELECT ow.hole, outline, min({box("op.px", "op.py", "f")}) AS away FROM ow JOIN op USING (hole) JOIN fr f ON f.found = outline GROUP BY ALL),
cv AS (SELECT f.found, {shared} AS cut FROM mr m JOIN fr f ON {meet} WHERE m.layer = 'green' AND m.n % 3 <> 1 GROUP BY ALL),
ok AS (SELECT op.*, outline FROM aw JOIN op USING (hole) JOIN fo ON fo.found = outline JOIN fm ON fm.found = outline JOIN fz ON fz.id = outline LEFT JOIN cv ON cv.found = outline
  WHERE away < {filling.HELD} AND m2 BETWEEN {good[0]} AND {good[1]} AND {ragged} AND coalesce(cut, 0) / fz.area < {filling.COVERED} QUALIFY row_number() OVER (PARTITION BY op.site, number ORDER BY hole) = 1)
SELECT op.site, op.hole, op.number, ok.outline, CASE WHEN ok.outline IS NULL THEN 'skipped' ELSE 'filled' END AS decision FROM op LEFT JOIN ok ON ok.hole = op.hole""",
        "fairway_fill": f"""WITH {common}, hl AS (SELECT *, k AS hole, n % 9 + 1 AS number, x + (n % 5 - 2) * 12000 AS bx, y + (n % 4 - 1) * 9000 + 5000 AS by_, x + (n % 5 - 2) * 6000 + (n * 41 % 91 - 45) * 100 AS fx, y + (n * 29 % 97 - 48) * 100 AS fy, 4000 AS fw, 6000 AS fh FROM pl WHERE golf = 'hole'),
l AS (SELECT site, hole, number, {flat("x")} AS au, {merc("y")} AS av, {flat("bx")} AS bu, {merc("by_")} AS bv FROM hl),
fw AS (SELECT * FROM hl WHERE n % 3 < 2), r AS (SELECT site, k AS feat, {flat("x0")} AS u0, {flat("x1")} AS u1, {merc("y0")} AS v0, {merc("y1")} AS v1 FROM ({rects("fw", "fx", "fy", "fw", "fh", "site, k")})),
near AS (SELECT r.feat, min({{'hole': l.hole, 'number': l.number}}).number AS number FROM r JOIN l USING (site) WHERE {gap} <= {filling.BESIDE**2} GROUP BY ALL),
f AS (SELECT fw.site, k AS feat, near.number AS by_line, n % 11 + 1 AS own, EXISTS (FROM l WHERE l.site = fw.site AND l.number = fw.n % 11 + 1) AS known FROM fw LEFT JOIN near ON near.feat = k)
SELECT site, feat, coalesce(by_line, own) AS number, '{fusion.MAPPED}' AS source FROM f UNION ALL SELECT DISTINCT site, NULL, number, 'centerline_buffer' FROM l WHERE (site, number) NOT IN (SELECT (site, coalesce(by_line, own)) FROM f WHERE by_line IS NOT NULL OR known)""",
    }
