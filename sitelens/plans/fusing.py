"""Queries on mapped layers fused with given points, and their SQL. Mapped: greens and tees as squares, lines, pins; given: other tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import metric, rings
from sitelens.operators import fusion, spatial
from sitelens.plans.assignment import PARS
from sitelens.sources.tables import features, sites

#: Half a square's side in degrees; metres of the given tables' scale, where features lie some hundred metres apart.
HALF, REACH = 0.001, 1200.0
LAYERS = {"green": "green", "tee": "tee", "hole": "hole_centerline", "pin": "pin", "bunker": "bunker"}
KINDS = {"practice": "tee", "rough": "pin", "cartpath": "green", "lateral_water_hazard": "dogleg"}


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).where(F.col("golf").isin(*LAYERS, *KINDS)).select("feat", "lon", "lat", "golf")
    return spatial.assign_to_sites(f, sites(spark, sf_dir)).drop("d2")


def _mapped(placed: DataFrame) -> DataFrame:
    x, y, at = F.col("lon"), F.col("lat"), lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    layer = F.create_map(*[F.lit(v) for kv in LAYERS.items() for v in kv])[F.col("golf")]
    shape = F.when(F.col("golf") == "pin", F.array(at(x, y))).when(F.col("golf") == "hole", F.array(at(x, y), at(x - F.lit(0.004), y + F.lit(0.003)))).otherwise(rings.box(x - HALF, y - HALF, x + HALF, y + HALF))
    hole = F.when(F.col("feat") % 7 == 0, F.col("feat") % 9 + 1)
    return placed.where(F.col("golf").isin(*LAYERS)).select("site", layer.alias("layer"), "feat", shape.alias("shape"), (~F.col("golf").isin("pin", "hole")).alias("area"), hole.alias("hole"), F.lit(None).cast("string").alias("source"))


def _given(placed: DataFrame) -> DataFrame:
    """Every other site has no tees given, every third no pins."""
    kind = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])[F.col("golf")]
    hole = F.when(F.col("feat") % 5 > 0, F.floor(F.col("feat") / 12) % 9 + 1)
    p = placed.where(F.col("golf").isin(*KINDS)).select("site", F.col("feat").alias("point"), kind.alias("kind"), hole.alias("hole"), "lon", "lat")
    return p.where("NOT (kind = 'tee' AND site % 2 = 1) AND NOT (kind IN ('pin', 'green') AND site % 3 = 1)")


def layer_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all sites after fusion: the point they come from, their hole, par and source."""
    placed = _placed(spark, sf_dir)
    cards = sites(spark, sf_dir).where("site % 5 > 0").select("site", F.array(*[F.lit(p) for p in PARS[:7]]).alias("pars"), F.lit(None).cast("array<int>").alias("indexes"))
    found = fusion.fused(_mapped(placed), _given(placed), cards, green_reach=REACH, tee_reach=REACH)
    return found.select("site", "layer", "feat", "point", "hole", "given_hole", F.col("par").cast("long").alias("par"), "source", "geom_source", F.size("shape").cast("long").alias("corners"))


def site_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as each site: where it comes from and its bounds; sites with a box have it as boundary."""
    boundary = sites(spark, sf_dir).select("site", F.when(F.col("west").isNotNull(), rings.box(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).alias("ring"))
    c = fusion.clips(_given(_placed(spark, sf_dir)).where("site % 4 > 0"), boundary)
    b = rings.bounds(F.col("ring"))
    return c.select("site", "origin", *[F.round(b[n], 7).alias(n) for n in ("west", "south", "east", "north")])


QUERIES = {f.__name__: f for f in (layer_fusion, site_clips)}


def oracles(assign: str) -> dict[str, str]:
    """SQL of the queries; assign: common tables up to a(feat, lon, lat, golf, site)."""
    rest = assign.removeprefix("WITH ")
    dbl = lambda v: f"CAST({v} AS DOUBLE)"
    case = lambda names: "CASE golf " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    square = lambda t: f"sqrt(greatest(abs(g.lon - {t}.lon) - {dbl(HALF)}, 0) ** 2 + greatest(abs(g.lat - {t}.lat) - {dbl(HALF)}, 0) ** 2) * {dbl(metric.METRES)}"
    away = lambda x, y: f"sqrt((p.lon - {x}) ** 2 + (p.lat - {y}) ** 2)"
    merc = lambda v, s: f"ln(tan(radians({v}) / 2 + pi() / 4)) * {dbl(metric.RADIUS)} {s} {fusion.MARGIN}"
    back = lambda v: f"degrees(atan(exp(({v}) / {dbl(metric.RADIUS)})) * 2 - pi() / 2)"
    pad = f"degrees({fusion.MARGIN} / {dbl(metric.RADIUS)})"
    points = f"""v AS (SELECT * FROM (SELECT site, feat AS point, {case(KINDS)} AS kind, CASE WHEN feat % 5 > 0 THEN feat // 12 % 9 + 1 END AS hole, lon, lat FROM a) WHERE kind IS NOT NULL
  AND NOT (kind = 'tee' AND site % 2 = 1) AND NOT (kind IN ('pin', 'green') AND site % 3 = 1))"""
    used = "(list_contains(ps, o.point) OR list_contains(fs, o.feat))"
    return {
        "layer_fusion": f"""WITH RECURSIVE {rest}, m AS (SELECT site, feat, {case(LAYERS)} AS layer, lon, lat, CASE WHEN feat % 7 = 0 THEN feat % 9 + 1 END AS hole FROM a), {points},
own AS (SELECT site, hole AS ta, 0 AS tb, point, hole, lon, lat FROM v WHERE kind IN ('pin', 'green') AND hole IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, hole ORDER BY kind DESC, point DESC) = 1),
pp AS (FROM own UNION ALL SELECT site, (kind = 'pin')::INT, point, point, hole, lon, lat FROM v WHERE kind IN ('pin', 'green') AND site NOT IN (SELECT site FROM own)),
t AS (SELECT * FROM v WHERE kind = 'tee'),
met AS (SELECT g.feat, p.hole FROM m g JOIN pp p USING (site) WHERE g.layer = 'green' AND {square("p")} < {REACH} QUALIFY row_number() OVER (PARTITION BY g.feat ORDER BY {square("p")}, ta, tb) = 1),
d AS (SELECT g.site, t.point, g.feat FROM m g JOIN t USING (site) WHERE g.layer = 'tee' AND {square("t")} <= {REACH}), o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY point, feat) AS n FROM d),
w AS (SELECT site, n, point, feat, true AS ok, [point] AS ps, [feat] AS fs FROM o WHERE n = 1
  UNION ALL SELECT o.site, o.n, o.point, o.feat, NOT {used}, CASE WHEN {used} THEN ps ELSE list_append(ps, o.point) END, CASE WHEN {used} THEN fs ELSE list_append(fs, o.feat) END FROM w JOIN o ON o.site = w.site AND o.n = w.n + 1),
took AS (SELECT point, feat FROM w WHERE ok),
far AS (SELECT t.site, t.hole, t.lon AS tx, t.lat AS ty, p.lon AS px, p.lat AS py FROM t JOIN pp p ON p.site = t.site AND p.hole = t.hole QUALIFY row_number() OVER (PARTITION BY t.site, t.hole ORDER BY {away("t.lon", "t.lat")} DESC, t.point) = 1),
drawn AS (SELECT far.site, far.hole, 2 + count(b.point) AS corners FROM far LEFT JOIN v b ON b.site = far.site AND b.hole = far.hole AND b.kind = 'dogleg' GROUP BY ALL),
l AS (SELECT site, feat, row_number() OVER (PARTITION BY site ORDER BY feat) AS n, (SELECT list(p.hole ORDER BY least({away("m.lon", "m.lat")}, {away("m.lon + 0.004", "m.lat - 0.003")}), p.hole) FROM pp p WHERE p.site = m.site AND p.hole IS NOT NULL) AS wish
  FROM m WHERE layer = 'hole_centerline' AND site NOT IN (SELECT site FROM drawn)),
q AS (SELECT site, n, feat, wish[1] AS hole, [wish[1]] AS hs FROM l WHERE n = 1 AND wish IS NOT NULL
  UNION ALL SELECT l.site, l.n, l.feat, coalesce(list_filter(wish, lambda h: NOT list_contains(q.hs, h))[1], wish[1]), list_append(q.hs, coalesce(list_filter(wish, lambda h: NOT list_contains(q.hs, h))[1], wish[1])) FROM q JOIN l ON l.site = q.site AND l.n = q.n + 1),
r AS (SELECT site, 'pin' AS layer, NULL::BIGINT AS feat, point, hole, NULL::BIGINT AS given_hole, NULL::BIGINT AS on_card, 'catalog' AS source, NULL AS geom_source, 1 AS corners FROM pp p
UNION ALL SELECT site, layer, feat, NULL, hole, NULL, NULL, '{fusion.MAPPED}', NULL, 1 FROM m WHERE layer = 'pin' AND site NOT IN (SELECT site FROM pp p)
UNION ALL SELECT site, layer, feat, NULL, coalesce(met.hole, m.hole), met.hole, NULL, NULL, NULL, 4 FROM m LEFT JOIN met USING (feat) WHERE layer = 'green' AND (coalesce(met.hole, m.hole) IS NOT NULL OR site NOT IN (SELECT site FROM pp p))
UNION ALL SELECT t.site, 'tee', took.feat, t.point, coalesce(t.hole, m.hole), CASE WHEN took.feat IS NOT NULL THEN t.hole END, NULL, 'catalog', CASE WHEN took.feat IS NOT NULL THEN '{fusion.MAPPED}' END, CASE WHEN took.feat IS NULL THEN 66 ELSE 4 END FROM t LEFT JOIN took USING (point) LEFT JOIN m ON m.feat = took.feat
UNION ALL SELECT site, layer, feat, NULL, hole, NULL, NULL, NULL, NULL, 4 FROM m WHERE layer = 'tee' AND site NOT IN (SELECT site FROM t)
UNION ALL SELECT site, 'hole_centerline', NULL, NULL, hole, NULL, hole, 'catalog', NULL, corners FROM drawn
UNION ALL SELECT l.site, 'hole_centerline', l.feat, NULL, coalesce(q.hole, m.hole), q.hole, q.hole, CASE WHEN l.site IN (SELECT site FROM v) THEN '{fusion.MAPPED}' END, NULL, 2 FROM l JOIN m USING (feat) LEFT JOIN q USING (feat)
UNION ALL SELECT site, layer, feat, NULL, hole, NULL, NULL, NULL, NULL, 4 FROM m WHERE layer = 'bunker')
SELECT site, layer, feat, point, hole::BIGINT AS hole, given_hole::BIGINT AS given_hole, CASE WHEN site % 5 > 0 THEN ({PARS[:7]})[on_card] END::BIGINT AS par, source, geom_source, corners::BIGINT AS corners FROM r""",
        "site_clips": f"""WITH {rest}, {points}, b AS (SELECT site, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM v WHERE site % 4 > 0 GROUP BY ALL)
SELECT site, 'given' AS origin, round(w - {pad}, 7) AS west, round({back(merc('s', '-'))}, 7) AS south, round(e + {pad}, 7) AS east, round({back(merc('n', '+'))}, 7) AS north FROM b
UNION ALL SELECT site, 'mapped', round(lon - {dbl(0.02)}, 7), round(lat - {dbl(0.02)}, 7), round(lon + {dbl(0.02)}, 7), round(lat + {dbl(0.02)}, 7) FROM boxes WHERE boxed AND site NOT IN (SELECT site FROM b)""",
    }
