"""Queries on drafts of holes, catalog answers, picks, shapes and grids, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import formats, metric, names, payloads, rings
from sitelens.operators import drafts, shapes, tours
from sitelens.plans.catalog import _of_site, _shapes
from sitelens.sources.tables import FEATURES_SQL, SITES_SQL, features, sites, table

#: Scale of the given tables: features lie some hundred metres apart.
CATCH, TOUCH, FAR, HALF, CELL_M = 450.0, 60.0, 1500.0, 0.002, 100.0
# Fixed value: the greatest elongation of a sand area.
SLIM = 5.5
# Sources that are not the map's, sources that are, tags of practice greens.
MADE, MAPPED, PRACTICE = ["imagery", "centerline_buffer", "pin", "imagery_pin"], ["openstreetmap", "osm", "hybrid", "osm_refined"], ["practice", "putting_green", "practice_green"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _of_site(spark, sf_dir, "hole").select("site", F.col("feat").alias("line"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    return line.select("*", (F.col("ax") + F.lit(0.004)).alias("bx"), (F.col("ay") - F.lit(0.003)).alias("by"))


def _right(spark: SparkSession, sf_dir: str, tag: str, name: str) -> DataFrame:
    return _of_site(spark, sf_dir, tag).select("site", F.col("feat").alias(name), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))


def hole_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a site's holes: by their ref, else the next free one."""
    n = F.floor(F.col("feat") / 12) % 30
    ref = F.when(F.col("feat") % 5 == 0, F.lit(None)).when(F.col("feat") % 5 == 1, F.concat(F.lit("hole "), n)).otherwise(n.cast("string"))
    holes = _lines(spark, sf_dir).select("site", F.col("line").alias("feat")).withColumn("ref", names.hole_number(ref))
    return drafts.draft_numbers(holes, "site", "feat", "ref").select("site", "feat", "number")


def hole_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a site's centerline must be reversed, by its nearest pins and the tees about its ends."""
    return drafts.turned(_lines(spark, sf_dir), _right(spark, sf_dir, "pin", "pin"), _right(spark, sf_dir, "tee", "tee"), CATCH)


def green_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greens of a site's holes: first by the pin, then by the end."""
    at = lambda c: F.when(F.col("line") % 2 == 0, F.col(c))
    holes = _lines(spark, sf_dir).select(F.col("line").alias("hole"), "site", F.col("bx").alias("ex"), F.col("by").alias("ey"), at("bx").alias("px"), at("by").alias("py"))
    greens = _right(spark, sf_dir, "green", "green")
    got = drafts.two_phase_greens(holes, greens, HALF, TOUCH, FAR)
    return got.select("hole", "green", F.col("phase").cast("long").alias("phase"))


def practice_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a green goes: practice greens, play (assigned to a hole or the map's own), or dropped."""
    k = F.col("feat")
    source = F.element_at(F.array(*[F.lit(x) for x in ("imagery", "osm", "pin", None, "survey", "hybrid")]), (F.floor(k / 12) % 6 + 1).cast("int"))
    f = features(spark, sf_dir).where(F.col("golf").isin("green", "practice")).select("feat", "golf", source.alias("source"), F.when(k % 7 == 0, k).alias("osm_id"), (k % 11 == 0).alias("assigned"))
    mapped = F.when(F.col("source").isin(*MADE), False).when(F.col("osm_id").isNotNull() | F.col("source").isin(*MAPPED), True).otherwise(F.col("source").isNull())
    route = F.when(F.col("golf").isin(*PRACTICE), "practice").when(F.col("assigned") | F.coalesce(mapped, F.lit(True)), "play").otherwise("dropped")
    return f.select("feat", route.alias("route"))


def catalog_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of courses out of JSON answers with several spellings of their keys."""
    k = F.col("o_orderkey")
    number = lambda c: F.format_string("%.6f", c)
    keys = {0: ("latitude", "longitude", "hole", "poi"), 1: ("lat", "lng", "holeNumber", "type"), 2: ("lat", "lon", "no", "name")}
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("1", "Flag", "12", "sandy wood", "8", "")]), (k % 6 + 1).cast("int"))

    def row(step: int) -> Column:
        out = F.lit(None)
        for r, (lat, lon, hole, kind) in keys.items():
            text = F.concat(F.lit(f'{{"{lat}":'), number(F.lit(38.0) + (k % 1000 + step) / F.lit(1000.0)), F.lit(f',"{lon}":"'), number(F.lit(-9.5) + k % 977 / F.lit(1000.0)), F.lit(f'","{hole}":'), k % 27, F.lit(f',"{kind}":"'), kinds, F.lit('","location":"'), k % 3 + 1, F.lit('"}'))
            out = F.when(k % 3 == r, text).otherwise(out)
        return out

    listed = F.concat(F.lit("["), row(0), F.lit(',7,{"lat":1},'), row(0), F.lit(","), row(2), F.lit("]"))
    payload = F.when(k % 4 == 0, listed).when(k % 4 == 3, F.lit("no json")).otherwise(F.concat(F.when(k % 4 == 1, '{"pois":').otherwise('{"data":'), listed, F.lit("}")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload"))
    p = payloads.points(o, "o_orderkey", "payload", F.lit(18))
    return p.select("o_orderkey", "hole", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def catalog_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of clubs out of JSON answers."""
    k = F.col("s_suppkey")
    course = lambda i: F.concat(F.lit('{"courseID":"'), F.when(k % 5 == i, "").otherwise(F.concat_ws("-", k, F.lit(i))), F.lit(f'","courseName":"{"" if i == 2 else f"Course {i}"}","latitude":'), k % 50 + i, F.lit(',"numHoles":"'), k % 3 * 9, F.lit(f'","hasGPS":{i % 2}}}'))
    listed = F.when(k % 4 == 0, "[]").otherwise(F.concat(F.lit("["), course(1), F.lit(","), course(2), F.lit("]")))
    lat = F.when(k % 2 == 0, F.concat(F.lit('"latitude":'), k % 90, F.lit(","))).otherwise("")
    payload = F.concat(F.lit('{"clubs":[{"clubID":"'), k, F.lit('","clubName":" '), F.col("s_name"), F.lit(' ",'), lat, F.lit('"courses":'), listed, F.lit("}]}"))
    return payloads.courses(table(spark, sf_dir, "supplier").select(payload.alias("payload")), "payload").drop("city", "lon")


def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 latest finished jobs that share neither key nor name with a later listed one (a top-k report)."""
    k = F.col("event_id")
    shown = F.concat(F.when(k % 2 == 0, "Course ").otherwise("COURSE "), k * 7 % 61)
    key = F.when(k % 3 == 0, F.concat(F.lit("catalog:"), F.col("user_id"))).when(k % 3 == 1, F.concat(F.lit("osm:"), k % 97)).otherwise(F.concat(F.lit("name:"), shown))
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    e = e.select(key.alias("key"), F.concat(F.lit("name:"), F.lower(F.trim(shown))).alias("name"), (-k).alias("turn"))
    kept = drafts.first_of_keys(e, ("key", "name"), "turn")
    return kept.orderBy("turn").limit(24).select((-F.col("turn")).alias("event_id"), "key")


def boundary_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's boundary among candidates: by id or the largest, by name and size, by snapping; the six best names."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("p_partkey")).distinct()
    c = c.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("double").alias("area")), "p_partkey")
    c = c.withColumn("score", F.round(names.similarity(F.col("p_name"), F.lit("The red ring")), 6)).withColumn("first", -F.col("p_partkey"))
    same = F.col("p_partkey") == F.col("site") * 3
    top = lambda *by: -F.max(F.struct(*by, "first"))["first"]
    picks = c.groupBy("site").agg(
        F.coalesce(F.max(F.when(same, F.col("p_partkey"))), top("area")).alias("by_id"),
        top((F.col("score") + F.least(F.col("area") * 0.02, F.lit(1.0))).alias("s")).alias("by_name"),
        F.when((F.max("score") < 0.2) & (F.count("*") > 1), top("area")).otherwise(top("score")).alias("snapped"),
        F.count_if(F.col("score") == 1.0).alias("exact"),
    )
    return picks


def site_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of a site's tees: corners, area, and the box of what lies within 130 m of them, padded."""
    # whole units of 0.000001 degrees keep the side tests exact
    t = _of_site(spark, sf_dir, "tee").select(F.col("site").alias("key"), *[F.round(F.col(c) * 1e6).alias(n) for c, n in (("lon", "x"), ("lat", "y"))])
    h = shapes.hulls(t).withColumn("ring", F.transform("ring", lambda p: F.struct((p.x / F.lit(1e6)).alias("x"), (p.y / F.lit(1e6)).alias("y"))))
    b = rings.bounds(F.col("ring"))
    box = metric.expand(metric.pad_box((b.west, b.south, b.east, b.north), 130.0), 0.0004)
    return h.select(F.col("key").alias("site"), F.size("ring").cast("long").alias("corners"), F.round(rings.area(F.col("ring")), 8).alias("area"), *[F.round(x, 7).alias(n) for n, x in zip("wsen", box, strict=True)])


def relation_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of relations (parts): rings put together from ways in any order and direction, holes taken off."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("relation"), (F.col("p_partkey") % 5 + 4).cast("int").alias("m"), (F.col("p_partkey") % 3 + 1).cast("double").alias("r"))
    k, i, m = F.col("relation"), F.col("i"), F.col("m")
    corner = lambda at: F.struct((F.col("r") * F.cos(at % m * (F.lit(2.0) * F.pi() / m))).alias("x"), (F.col("r") * F.sin(at % m * (F.lit(2.0) * F.pi() / m))).alias("y"))
    way = F.array(corner(i), corner(i + 1))
    outer = p.withColumn("i", F.explode(F.sequence(F.lit(0), m - 1))).select("relation", ((i * 7 + k) % (m * 11)).cast("long").alias("place"), F.when(i % 2 == 0, "outer").otherwise("").alias("role"), F.when((i + k) % 2 == 0, way).otherwise(F.reverse(way)).alias("points"))
    q = 0.25
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    halves = F.array(*[F.struct(F.lit(n).cast("long").alias("place"), F.array(*[point(*c) for c in cs]).alias("points")) for n, cs in ((2, [(-q, -q), (q, -q), (q, q)]), (1, [(-q, -q), (-q, q), (q, q)]))])
    inner = p.where("relation % 2 = 0").withColumn("h", F.explode(halves)).select("relation", "h.place", F.lit("inner").alias("role"), "h.points")
    found = shapes.relation_rings(outer.unionByName(inner))
    sign = F.when(F.col("role") == "inner", -1).otherwise(1)
    return found.groupBy("relation").agg(F.round(F.sum(sign * rings.area(F.col("ring"))), 6).alias("area"), F.count("*").alias("rings"), F.sum(F.size("ring")).alias("corners"))


def tee_green_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of a site from its tees and greens: pairs along fairways first, numbered by a tour from the site's centre."""
    at = lambda tag, name: _of_site(spark, sf_dir, tag).select("site", F.col("feat").alias(name), "lon", "lat")
    half = F.lit(HALF)
    boxes = at("fairway", "fairway").select("site", "fairway", (F.col("lon") - half).alias("w"), (F.col("lat") - half).alias("s"), (F.col("lon") + half).alias("e"), (F.col("lat") + half).alias("n"))
    origins = sites(spark, sf_dir).select("site", F.col("lon").alias("ox"), F.col("lat").alias("oy"))
    return tours.drafted(at("tee", "tee"), at("green", "green").withColumnsRenamed({"lon": "rlon", "lat": "rlat"}), boxes, origins)


def hull_elongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length over width of the smallest rectangles around a site's tees, and whether a sand area of that form is accepted."""
    t = _of_site(spark, sf_dir, "tee").select(F.col("site").alias("key"), *[F.round(F.col(c) * 1e6).alias(n) for c, n in (("lon", "x"), ("lat", "y"))])
    ratio = F.round(rings.elongation(F.transform("ring", lambda p: F.struct((p.x / F.lit(1e6)).alias("x"), (p.y / F.lit(1e6)).alias("y")))), 4)
    h = shapes.hulls(t).where(F.size("ring") > 2).select(F.col("key").alias("site"), ratio.alias("elongation"))
    return h.select("site", "elongation", (F.col("elongation") <= SLIM).alias("fits"))


def buffer_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square metres on the ellipsoid of sites' boxes, of circles about them and of corridors from them."""
    s = sites(spark, sf_dir)
    lon, lat = F.col("lon"), F.col("lat")
    box = metric.or_default(tuple(F.col(c) for c in ("west", "south", "east", "north")), lon, lat)
    round_ = metric.capsule(lon, lat, lon, lat, 130.0)
    strip = metric.capsule(lon, lat, lon + F.lit(0.004), lat - F.lit(0.003), 28.0)
    return s.select("site", F.round(metric.ellipsoid_area(rings.box(*box)), 1).alias("box"), F.round(metric.ellipsoid_area(round_), 2).alias("circle"), F.round(metric.ellipsoid_area(strip), 2).alias("corridor"), rings.contains(strip, lon + F.lit(0.002), lat - F.lit(0.0015)).alias("holds_middle"))


def occupancy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a site's occupancy grid as text: . free, # blocked (bunkers), ? unknown."""
    s = sites(spark, sf_dir).where("west IS NOT NULL")
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("west"), lat), (lon, F.col("south")), (F.col("east"), lat), (lon, F.col("north")))])
    b = _of_site(spark, sf_dir, "bunker").select("site", (lon - HALF).alias("w"), (lat - HALF).alias("s"), (lon + HALF).alias("e"), (lat + HALF).alias("n"))
    cells = shapes.occupancy(s.select("site", ring.alias("ring")), b, CELL_M)
    sign = F.when(F.col("value") == shapes.BLOCKED, "#").when(F.col("value") == shapes.FREE, ".").otherwise("?")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", sign.alias("s")))), lambda c: c.s), "")
    return cells.groupBy("site", "row").agg(line.alias("line")).select("site", F.col("row").cast("long").alias("row"), "line")


def dxf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as DXF entities."""
    s = _shapes(spark, sf_dir)
    return s.select("feat", formats.dxf(F.col("kind"), F.col("points"), F.col("layer")).alias("dxf"))


QUERIES = {f.__name__: f for f in (hole_drafts, hole_directions, green_claims, practice_routes, catalog_points, catalog_courses, job_listing, boundary_picks, tee_green_tours, hull_elongation, site_hulls, relation_rings, buffer_areas, occupancy_rows, dxf_rows)}


def _greedy(name: str, pairs: str) -> str:
    """Common tables of a greedy pass over pairs(site, hole, green, d2): name(hole, green)."""
    took = "(list_contains(hs, o.hole) OR list_contains(gs, o.green))"
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d2, hole, green) AS k FROM {pairs}),
{name}_w AS (SELECT site, k, hole, green, true AS ok, [hole] AS hs, [green] AS gs FROM {name}_o WHERE k = 1
  UNION ALL SELECT o.site, o.k, o.hole, o.green, NOT {took}, CASE WHEN {took} THEN hs ELSE list_append(hs, o.hole) END, CASE WHEN {took} THEN gs ELSE list_append(gs, o.green) END
  FROM {name}_w w JOIN {name}_o o ON o.site = w.site AND o.k = w.k + 1),
{name} AS (SELECT hole, green FROM {name}_w WHERE ok)"""


def _capsule_sql(ax: str, ay: str, bx: str, by: str, metres: float) -> str:
    """Corners (i, x, y) of a capsule by site, in degrees: table expression over m(site, x0, y0, x1, y1)."""
    r = f"CAST({metric.RADIUS} AS DOUBLE)"
    mx, my = (lambda v: f"radians({v}) * {r}"), (lambda v: f"ln(tan(radians({v}) / 2 + pi() / 4)) * {r}")
    return f"""(SELECT site, i, degrees((x0 + (x1 - x0) * (i <= 32)::INT + cos(t) * {metres}) / {r}) AS x, degrees(atan(exp((y0 + (y1 - y0) * (i <= 32)::INT + sin(t) * {metres}) / {r})) * 2 - pi() / 2) AS y
 FROM (SELECT site, i, x0, y0, x1, y1, atan2(y1 - y0, x1 - x0) + CASE WHEN i <= 32 THEN -pi() / 2 + i * pi() / 32 ELSE pi() / 2 + (i - 33) * pi() / 32 END AS t
  FROM (SELECT site, {mx(ax)} AS x0, {my(ay)} AS y0, {mx(bx)} AS x1, {my(by)} AS y1 FROM own) CROSS JOIN range(66) g(i)))"""


def oracles(assign: str, layer: str) -> dict[str, str]:
    """SQL of the queries; assign: common tables up to a(feat, lon, lat, golf, site), layer: the layer of a feature."""
    rest = assign.removeprefix("WITH ")
    m = f"CAST({metric.METRES} AS DOUBLE)"
    dbl = lambda v: f"CAST({v} AS DOUBLE)"
    line = f"l AS (SELECT site, feat AS line, lon AS ax, lat AS ay, lon + {dbl(0.004)} AS bx, lat - {dbl(0.003)} AS by FROM a WHERE golf = 'hole')"
    dist = lambda e, t: f"sqrt((l.{e}x - {t}.lon) * (l.{e}x - {t}.lon) + (l.{e}y - {t}.lat) * (l.{e}y - {t}.lat)) * {m}"
    away = lambda e: f"coalesce((SELECT min({dist(e, 'p')}) FROM a p WHERE p.golf = 'pin' AND p.site = l.site), 1e9)"
    tees = lambda e: f"(SELECT count(*) FROM a t WHERE t.golf = 'tee' AND t.site = l.site AND {dist(e, 't')} < {CATCH})"
    rim = "power(greatest(abs(l.bx - g.lon) - {h}, 0), 2) + power(greatest(abs(l.by - g.lat) - {h}, 0), 2)".replace("{h}", dbl(HALF))
    centre = "(l.bx - g.lon) * (l.bx - g.lon) + (l.by - g.lat) * (l.by - g.lat)"
    q = lambda v: f"(1 - e2) * (sin(radians({v})) / (1 - e2 * sin(radians({v})) * sin(radians({v}))) - 1 / (2 * sqrt(e2)) * ln((1 - sqrt(e2) * sin(radians({v}))) / (1 + sqrt(e2) * sin(radians({v})))))"
    flat = f"{dbl(metric.FLAT)} * (2 - {dbl(metric.FLAT)})"
    own = f"""own AS (SELECT site, lon, lat, CASE WHEN boxed THEN lon - {dbl(0.02)} ELSE lon - {dbl(0.012)} END AS w, CASE WHEN boxed THEN lat - {dbl(0.02)} ELSE lat - {dbl(0.012)} END AS s,
  CASE WHEN boxed THEN lon + {dbl(0.02)} ELSE lon + {dbl(0.012)} END AS e, CASE WHEN boxed THEN lat + {dbl(0.02)} ELSE lat + {dbl(0.012)} END AS n, {flat} AS e2 FROM boxes)"""
    around = lambda t: f"(SELECT site, abs(sum((x2 - x1) * ((q1 + q2) / 2 - fq))) / 2 * power({dbl(metric.RADIUS)}, 2) AS area FROM (SELECT site, fq, radians(x) AS x1, qy AS q1, radians(lead(x, 1, fx) OVER (PARTITION BY site ORDER BY i)) AS x2, lead(qy, 1, fq) OVER (PARTITION BY site ORDER BY i) AS q2 FROM (SELECT *, first(x) OVER (PARTITION BY site ORDER BY i) AS fx, first(qy) OVER (PARTITION BY site ORDER BY i) AS fq FROM (SELECT site, i, x, {q('y')} AS qy FROM (SELECT *, {flat} AS e2 FROM {t})))) GROUP BY site)"
    kinds = " ".join(f"WHEN k % 6 = {i} THEN '{v}'" for i, v in enumerate(("green", "pin", "tee", "bunker", "poi", "poi")))
    num = lambda e: f"printf('%.7f', {e})"
    pt = lambda dx, dy: "'10' || chr(10) || " + num(f"lon + {dbl(dx)}" if dx else "lon") + " || chr(10) || '20' || chr(10) || " + num(f"lat + {dbl(dy)}" if dy else "lat")
    poly = " || chr(10) || ".join(pt(*c) for c in ((0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001), (0, 0)))
    head = lambda name: f"'0' || chr(10) || '{name}' || chr(10) || '8' || chr(10) || layer || chr(10)"
    run = lambda n, flag, body: f"{head('LWPOLYLINE')} || '90' || chr(10) || '{n}' || chr(10) || '70' || chr(10) || '{flag}' || chr(10) || {body}"
    merc = lambda v, s: f"ln(tan(radians({v}) / 2 + pi() / 4)) * {dbl(metric.RADIUS)} {s} 130"
    back = lambda v: f"degrees(atan(exp(({v}) / {dbl(metric.RADIUS)})) * 2 - pi() / 2)"
    size = lambda span, per: f"least(greatest(floor(({span}) * {per} / {CELL_M})::INT, {shapes.LEAST}), {shapes.MOST})"
    return {
        "hole_drafts": f"""WITH {rest}, h AS (SELECT site, feat, CASE WHEN feat % 5 = 0 THEN NULL WHEN feat // 12 % 30 BETWEEN 1 AND 27 THEN feat // 12 % 30 END AS ref FROM a WHERE golf = 'hole'),
u AS (SELECT site, list(DISTINCT ref) FILTER (WHERE ref IS NOT NULL) AS used FROM h GROUP BY 1), f AS (SELECT site, feat, row_number() OVER (PARTITION BY site ORDER BY feat) AS i FROM h WHERE ref IS NULL)
SELECT site, feat, ref::BIGINT AS number FROM h WHERE ref IS NOT NULL UNION ALL SELECT f.site, feat, list_filter(range(1, 30 + i), lambda n: NOT coalesce(list_contains(used, n), false))[i]::BIGINT FROM f JOIN u ON u.site = f.site""",
        "hole_directions": f"WITH {rest}, {line}, w AS (SELECT line, {away('a')} AS pa, {away('b')} AS pb, {tees('a')} AS ta, {tees('b')} AS tb FROM l) SELECT line, CASE WHEN pa + 6 < pb THEN true WHEN pb + 6 < pa THEN false ELSE tb > ta END AS turned FROM w",
        "green_claims": f"""WITH RECURSIVE {rest}, {line}, g AS (SELECT site, feat, lon, lat FROM a WHERE golf = 'green'),
c AS (SELECT l.site, line AS hole, feat AS green, {centre} AS d2 FROM l JOIN g ON l.site = g.site WHERE line % 2 = 0 AND {rim} < power({TOUCH} / {m}, 2)),
{_greedy("one", "c")},
c2 AS (SELECT l.site, line AS hole, feat AS green, {rim} AS d2 FROM l JOIN g ON l.site = g.site WHERE {rim} <= power({FAR} / {m}, 2) AND line NOT IN (SELECT hole FROM one) AND feat NOT IN (SELECT green FROM one)),
{_greedy("two", "c2")}
SELECT hole, green, 1::BIGINT AS phase FROM one UNION ALL SELECT hole, green, 2 FROM two""",
        "practice_routes": f"""WITH {FEATURES_SQL}, s AS (SELECT feat, golf, CASE feat // 12 % 6 WHEN 0 THEN 'imagery' WHEN 1 THEN 'osm' WHEN 2 THEN 'pin' WHEN 4 THEN 'survey' WHEN 5 THEN 'hybrid' END AS source FROM feats WHERE golf IN ('green', 'practice'))
SELECT feat, CASE WHEN golf = 'practice' THEN 'practice' WHEN feat % 11 = 0 THEN 'play' WHEN source IN ('imagery', 'pin') THEN 'dropped' WHEN source IS NULL OR feat % 7 = 0 OR source IN ('osm', 'hybrid') THEN 'play' ELSE 'dropped' END AS route FROM s""",
        "catalog_points": f"""SELECT DISTINCT o_orderkey, CASE WHEN h = 0 THEN NULL WHEN h > 18 THEN h - 18 ELSE h END AS hole, CASE WHEN kind = 'green' AND k % 3 = 1 THEN 'pin' ELSE kind END AS kind, round(38 + (k % 1000 + step)::DOUBLE / 1000, 6) AS lat, round(-9.5 + (k % 977)::DOUBLE / 1000, 6) AS lon
FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 27 AS h, CASE {kinds} END AS kind, unnest([0, 2]) AS step FROM orders WHERE o_orderkey % 4 <> 3)""",
        "catalog_courses": """SELECT s_suppkey::VARCHAR AS club_id, s_name AS club_name, s_suppkey || '-' || i AS course_id, CASE WHEN i = 2 THEN s_name ELSE 'Course 1' END AS course_name, (CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 90 > 0 THEN s_suppkey % 90 ELSE s_suppkey % 50 + i END)::DOUBLE AS lat,
  nullif(s_suppkey % 3 * 9, 0) AS num_holes, i = 1 AS has_gps FROM (SELECT *, unnest([1, 2]) AS i FROM supplier WHERE s_suppkey % 4 <> 0) WHERE s_suppkey % 5 <> i""",
        "job_listing": """WITH RECURSIVE e AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'Course ' ELSE 'COURSE ' END || event_id * 7 % 61 AS shown, user_id FROM events WHERE event_type <> 'error'),
p AS (SELECT max(event_id) AS event_id, CASE event_id % 3 WHEN 0 THEN 'catalog:' || user_id WHEN 1 THEN 'osm:' || event_id % 97 ELSE 'name:' || shown END AS key, 'name:' || lower(shown) AS name FROM e GROUP BY 2, 3),
o AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS k FROM p),
w AS (SELECT k, event_id, key, true AS ok, [key, name] AS seen FROM o WHERE k = 1 UNION ALL
  SELECT o.k, o.event_id, o.key, NOT list_has_any(seen, [o.key, o.name]), CASE WHEN list_has_any(seen, [o.key, o.name]) THEN seen ELSE list_concat(seen, [o.key, o.name]) END FROM w JOIN o ON o.k = w.k + 1)
SELECT event_id, key FROM w WHERE ok ORDER BY k LIMIT 24""",
        "boundary_picks": """WITH c AS (SELECT DISTINCT l_suppkey AS site, p_partkey, p_size::DOUBLE AS area, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, round(len(list_intersect(list_distinct(t), ['red', 'ring']))::DOUBLE / len(list_distinct(list_concat(t, ['red', 'ring']))), 6) AS score FROM c),
big AS (SELECT site, p_partkey FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY area DESC, p_partkey) = 1), best AS (SELECT site, p_partkey, score FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, p_partkey) = 1),
named AS (SELECT site, p_partkey FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY score + least(area * CAST(0.02 AS DOUBLE), 1) DESC, p_partkey) = 1), n AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE score = 1) AS exact, max(CASE WHEN p_partkey = site * 3 THEN p_partkey END) AS own FROM s GROUP BY 1)
SELECT n.site, coalesce(own, big.p_partkey) AS by_id, named.p_partkey AS by_name, CASE WHEN best.score < 0.2 AND n > 1 THEN big.p_partkey ELSE best.p_partkey END AS snapped, exact FROM n JOIN big USING (site) JOIN best USING (site) JOIN named USING (site)""",
        "site_hulls": f"""WITH {rest}, t AS (SELECT site, feat, round(lon * 1e6) AS x, round(lat * 1e6) AS y FROM a WHERE golf = 'tee'),
e AS (SELECT p.site, p.x * q.y - q.x * p.y AS c FROM t p JOIN t q ON p.site = q.site AND p.feat <> q.feat WHERE NOT EXISTS (SELECT 1 FROM t r WHERE r.site = p.site AND r.feat NOT IN (p.feat, q.feat) AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR (q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (q.x - p.x) * (r.x - q.x) + (q.y - p.y) * (r.y - q.y) > 0
  OR (q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) < 0))),
b AS (SELECT site, count(*) AS n, min(x) / 1e6 AS w, min(y) / 1e6 AS s, max(x) / 1e6 AS e, max(y) / 1e6 AS n2 FROM t GROUP BY 1), h AS (SELECT site, count(*) AS corners, sum(c) / 2e12 AS area FROM e GROUP BY 1)
SELECT b.site, CASE WHEN n < 3 THEN n ELSE corners END AS corners, round(CASE WHEN n < 3 THEN 0 ELSE abs(area) END, 8) AS area, round(w - degrees(130 / {dbl(metric.RADIUS)}) - {dbl(0.0004)}, 7) AS w, round({back(merc('s', '-'))} - {dbl(0.0004)}, 7) AS s,
  round(e + degrees(130 / {dbl(metric.RADIUS)}) + {dbl(0.0004)}, 7) AS e, round({back(merc('n2', '+'))} + {dbl(0.0004)}, 7) AS n FROM b LEFT JOIN h USING (site)""",
        "tee_green_tours": f"""WITH RECURSIVE {rest}, fair AS (SELECT site, lon - {dbl(HALF)} AS w, lat - {dbl(HALF)} AS s, lon + {dbl(HALF)} AS e, lat + {dbl(HALF)} AS n FROM a WHERE golf = 'fairway'),
b AS (SELECT t.site, t.feat AS tee, g.feat AS green, t.lon AS ax, t.lat AS ay, g.lon - t.lon AS dx, g.lat - t.lat AS dy FROM a t JOIN a g ON t.site = g.site AND t.golf = 'tee' AND g.golf = 'green'),
h AS (SELECT tee, green, count(*) AS hits FROM b JOIN fair USING (site) WHERE greatest(least((w - ax) / dx, (e - ax) / dx), least((s - ay) / dy, (n - ay) / dy), 0) <= least(greatest((w - ax) / dx, (e - ax) / dx), greatest((s - ay) / dy, (n - ay) / dy), 1) GROUP BY ALL),
c AS (SELECT site, tee, green, round(sqrt(dx * dx + dy * dy) * coalesce({dbl(0.35)} / hits, 1), 12) AS cost FROM b LEFT JOIN h USING (tee, green)),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cost, tee, green) AS k FROM c),
paired AS (SELECT site, k, tee, green, true AS ok, [tee] AS ts, [green] AS gs FROM o WHERE k = 1
  UNION ALL SELECT o.site, o.k, o.tee, o.green, NOT (list_contains(ts, o.tee) OR list_contains(gs, o.green)), CASE WHEN list_contains(ts, o.tee) OR list_contains(gs, o.green) THEN ts ELSE list_append(ts, o.tee) END,
    CASE WHEN list_contains(ts, o.tee) OR list_contains(gs, o.green) THEN gs ELSE list_append(gs, o.green) END FROM paired p JOIN o ON o.site = p.site AND o.k = p.k + 1),
g AS (SELECT site, feat AS green, lon, lat FROM a WHERE golf = 'green'),
t AS (SELECT site, 0 AS number, NULL::BIGINT AS green, lon AS x, lat AS y, []::BIGINT[] AS seen FROM sites
  UNION ALL SELECT site, number + 1, green, lon, lat, list_append(seen, green) FROM (SELECT t.site, number, g.green, lon, lat, seen, row_number() OVER (PARTITION BY t.site ORDER BY (lon - x) ** 2 + (lat - y) ** 2, g.green) AS r FROM t JOIN g ON g.site = t.site AND NOT list_contains(seen, g.green)) WHERE r = 1)
SELECT t.site, t.number::BIGINT AS number, t.green, p.tee FROM t LEFT JOIN paired p ON p.site = t.site AND p.green = t.green AND p.ok WHERE t.green IS NOT NULL""",
        "hull_elongation": f"""WITH {rest}, pts AS (SELECT DISTINCT site, round(lon * 1e6) / 1e6 AS x, round(lat * 1e6) / 1e6 AS y FROM a WHERE golf = 'tee'),
u AS (SELECT m.site, m.x AS mx, m.y AS my, n.x AS nx, n.y AS ny, (n.x - m.x) / sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2) AS ux, (n.y - m.y) / sqrt((n.x - m.x) ** 2 + (n.y - m.y) ** 2) AS uy FROM pts m JOIN pts n ON m.site = n.site AND (m.x <> n.x OR m.y <> n.y)),
s AS (SELECT u.site, mx, my, nx, ny, max(x * ux + y * uy) - min(x * ux + y * uy) AS f, max(y * ux - x * uy) - min(y * ux - x * uy) AS o FROM u JOIN pts p ON p.site = u.site GROUP BY ALL),
r AS (SELECT site, round(greatest(f, o) / least(f, o), 4) AS elongation, row_number() OVER (PARTITION BY site ORDER BY round(f * o, 12), greatest(f, o) / least(f, o)) AS k FROM s)
SELECT site, elongation, elongation <= {SLIM} AS fits FROM r WHERE k = 1 AND elongation < 1e9""",
        "relation_rings": """SELECT p_partkey AS relation, round(m / 2.0 * r * r * sin(2 * pi() / m) - CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END, 6) AS area, (1 + (p_partkey % 2 = 0)::INT)::BIGINT AS rings, (m + 4 * (p_partkey % 2 = 0)::INT)::BIGINT AS corners
FROM (SELECT p_partkey, p_partkey % 5 + 4 AS m, (p_partkey % 3 + 1)::DOUBLE AS r FROM part)""",
        "buffer_areas": f"""WITH {SITES_SQL}, {own}, c AS {around(_capsule_sql('lon', 'lat', 'lon', 'lat', 130.0))}, k AS {around(_capsule_sql('lon', 'lat', f'lon + {dbl(0.004)}', f'lat - {dbl(0.003)}', 28.0))}
SELECT own.site, round(radians(e - w) * abs({q('n')} - ({q('s')})) / 2 * power({dbl(metric.RADIUS)}, 2), 1) AS box, round(c.area, 2) AS circle, round(k.area, 2) AS corridor, true AS holds_middle FROM own JOIN c ON c.site = own.site JOIN k ON k.site = own.site""",
        "occupancy_rows": f"""WITH {rest}, s AS (SELECT site, lon, lat, lon - {dbl(0.02)} AS w, lat - {dbl(0.02)} AS s, lon + {dbl(0.02)} AS e, lat + {dbl(0.02)} AS n FROM boxes WHERE boxed),
g AS (SELECT *, {size('e - w', f'({shapes.MX} * cos(radians((s + n) / 2)))')} AS width, {size('n - s', shapes.MY)} AS height FROM s),
c AS (SELECT *, w + (col + 0.5::DOUBLE) * (e - w) / width AS x, n - (row + 0.5::DOUBLE) * (n - s) / height AS y FROM (SELECT *, unnest(range(width)) AS col FROM (SELECT *, unnest(range(height)) AS row FROM g)))
SELECT site, row::BIGINT AS row, string_agg(CASE WHEN EXISTS (SELECT 1 FROM a b WHERE b.golf = 'bunker' AND b.site = c.site AND abs(b.lon - x) < {dbl(HALF)} AND abs(b.lat - y) < {dbl(HALF)}) THEN '#' WHEN abs(x - lon) + abs(y - lat) < {dbl(0.02)} THEN '.' ELSE '?' END, '' ORDER BY col) AS line FROM c GROUP BY 1, 2""",
        "dxf_rows": f"""WITH {FEATURES_SQL}, s AS (SELECT *, {layer} AS layer FROM feats) SELECT feat, CASE layer WHEN 'hole_centerline' THEN {run(2, 0, f"{pt(0, 0)} || chr(10) || {pt(0.001, 0.002)}")} WHEN 'pin' THEN {head('POINT')} || {pt(0, 0)} || chr(10) || '30' || chr(10) || '0.0' ELSE {run(5, 1, poly)} END AS dxf FROM s""",
    }
