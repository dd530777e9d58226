"""Queries on assignment joins, names, rings, painting and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import names, rings, tags
from sitelens.operators import matching, spatial
from sitelens.sources.tables import FEATURES_SQL, features, sites, table
from sitelens.streaming import live

QUERY = "supplier 00 the club"
# Strokes by hole.
PARS = [4, 5, 3, 4, 4, 3, 5, 4, 4]
# Classes in the order in which they are painted, later ones win.
PAINT = [
    "woodland",
    "natural_rough",
    "managed_rough",
    "driving_range",
    "putting_green",
    "practice",
    "fairway",
    "first_cut",
    "water",
    "bunker",
    "sand",
    "tee",
    "green",
    "cart_path",
    "walking_path",
    "road",
    "parking",
    "building",
    "bridge",
    "tree",
]


def _in_sites(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    f = features(spark, sf_dir).where(F.col("golf") == tag).select("feat", "lon", "lat")
    return spatial.assign_to_sites(f, sites(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str, tag: str, other: str, reach: float) -> DataFrame:
    """Pairs of a site's features of two kinds within reach degrees."""
    a = _in_sites(spark, sf_dir, tag).select("site", F.col("feat").alias(tag), "lon", "lat")
    b = _in_sites(spark, sf_dir, other).select("site", F.col("feat").alias(other), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    return spatial.near(a, b, reach, ["site"]).select("site", tag, other, "d2")


def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins and holes of a site, each used once, nearest pairs first, within 0.02 degrees."""
    near = _pairs(spark, sf_dir, "pin", "hole", 0.02)
    return matching.greedy_pairs(near, "pin", "hole", "d2").select("site", "pin", "hole", F.round("d2", 9).alias("d2"))


def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tee's nearest hole of its site, closer than 0.015 degrees."""
    return matching.nearest_pairs(_pairs(spark, sf_dir, "tee", "hole", 0.015), "tee", "hole", "d2", 0.015 * 0.015).select("tee", "hole", F.round("d2", 9).alias("d2"))


def self_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of centerlines, one for each order; whole units of 0.000001 degrees keep the side tests exact."""
    k = F.col("o_orderkey")
    n = lambda a, b: (k % a * (k % b) % 1000003).cast("double")
    s = table(spark, sf_dir, "orders").select(k.alias("id"), n(100003, 100019).alias("x0"), n(100043, 100049).alias("y0"))
    s = s.select("id", "x0", "y0", (F.col("x0") + (F.col("id") * 7919 % 6001 - 3000)).alias("x1"), (F.col("y0") + (F.col("id") * 104729 % 6001 - 3000)).alias("y1"))
    return matching.crossings(s, 6000.0)


def spatial_semi_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in any site's box, padded by 0.0004 degrees, through shared cells."""
    pad, cell = 0.0004, spatial.CELL
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    s = sites(spark, sf_dir).where("west IS NOT NULL").select((F.col("west") - pad).alias("w"), (F.col("south") - pad).alias("s"), (F.col("east") + pad).alias("e"), (F.col("north") + pad).alias("n"))
    s = s.withColumn("cx", F.explode(F.sequence(at(F.col("w")), at(F.col("e"))))).withColumn("cy", F.explode(F.sequence(at(F.col("s")), at(F.col("n")))))
    f = features(spark, sf_dir).select("feat", "lon", "lat", at(F.col("lon")).alias("cx"), at(F.col("lat")).alias("cy"))
    inside = (f.cx == s.cx) & (f.cy == s.cy) & f.lon.between(s.w, s.e) & f.lat.between(s.s, s.n)
    return f.join(s, inside, "left_semi").select("feat")


def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(names.similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand", F.lit("golf part"))), 6).alias("score"))


def hit_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best hits of a search for a site's name (a top-k report)."""
    k = F.col("s_suppkey")
    course = F.concat(F.lit("The course "), F.lpad((k % 7).cast("string"), 2, "0"))
    holes = F.element_at(F.array(F.lit(9), F.lit(18), F.lit(27), F.lit(None)), (k % 4 + 1).cast("int"))
    away = F.when(k % 5 != 0, (k % 37) / F.lit(2.0))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(names.search_score(QUERY, F.col("s_name"), course, k % 2 == 0, holes, away), 6).alias("score"))
    return s.orderBy(F.desc("score"), "s_suppkey").limit(40)


def params_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", names.params_key("clubs/search", status=F.col("o_orderstatus"), customer=F.col("o_custkey")).alias("key"))


def _ring() -> Column:
    """A box of p_size by p_partkey % 7 + 1."""
    w, h, zero = F.col("p_size").cast("double"), (F.col("p_partkey") % 7 + 1).cast("double"), F.lit(0.0)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])


def ring_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _ring().alias("r"))
    return p.select("p_partkey", F.round(rings.area(F.col("r")), 6).alias("area"), F.round(rings.perimeter(F.col("r")), 6).alias("perimeter"), F.round(rings.compactness(F.col("r")), 6).alias("compactness"))


def chip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 x 512 pixels, 384 apart both ways, the last ones moved back to the edge; one image per part."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).alias("h"), (F.col("p_partkey") % 11 * 211).alias("w"))
    starts = lambda n: F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 512, F.lit(0).cast("long")), F.lit(384).cast("long")), F.array(F.greatest(n.cast("long") - 512, F.lit(0).cast("long")))))
    return p.where("h > 0 AND w > 0").select("p_partkey", F.explode(starts(F.col("h"))).alias("y"), starts(F.col("w")).alias("xs")).select("p_partkey", "y", F.explode("xs").alias("x"))


def scorecard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of a hole on a nine-hole card; wrapped: of hole ((h - 1) mod 9) + 1."""
    hole = (F.col("l_partkey") % 27 + 1).cast("int")
    pars = F.array(*[F.lit(p) for p in PARS])
    x = table(spark, sf_dir, "lineitem").select(hole.alias("hole"), F.try_element_at(pars, hole).alias("par"), F.element_at(pars, (hole - 1) % 9 + 1).alias("wrapped"))
    return x.groupBy("hole").agg(F.max("par").alias("par"), F.max("wrapped").alias("wrapped"), F.count("*").alias("n"))


def bounds_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and mean point of each layer."""
    f = features(spark, sf_dir).withColumn("layer", tags.golf_layer(F.col("golf")))
    return f.groupBy("layer").agg(*[F.round(g(c), 6).alias(f"{n}_{c}") for n, g in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in ("lon", "lat")])


def validity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg((F.col("l_quantity") >= 10).cast("double")), 6).alias("ratio"))


def topology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes (customers) without a green (order), with several, and greens without a hole."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("hole")).join(n, "k", "full")
    return j.agg(
        F.count_if(F.col("n").isNull()).alias("holes_without_green"),
        F.count_if(F.col("hole").isNotNull() & (F.col("n") > 1)).alias("holes_with_multiple_greens"),
        F.coalesce(F.sum(F.when(F.col("hole").isNull(), F.col("n"))), F.lit(0)).alias("greens_without_hole"),
    )


def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by whether they are fresh: seen within 7 days of the newest of their type."""
    e = table(spark, sf_dir, "events")
    newest = e.groupBy("event_type").agg(F.max("ts").alias("now"))
    fresh = F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")
    return e.join(F.broadcast(newest), "event_type").groupBy("event_type", fresh.alias("fresh")).agg(F.count("*").alias("n"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.event_counts(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (greedy_one_to_one, nearest_within, self_crossings, spatial_semi_clip, name_jaccard, hit_score_topk, params_hash, ring_compactness, chip_windows, scorecard_lookup, bounds_mean, validity_ratio, topology_counts, cache_ttl, stream_counts)
}


def oracles(assign: str, layer: str) -> dict[str, str]:
    """SQL of the queries; assign: common tables up to a(feat, lon, lat, golf, site), layer: the layer of a feature."""
    pair = lambda a, b: f"""{assign}, pr AS (SELECT x.site, x.feat AS {a}, y.feat AS {b}, (x.lon - y.lon) * (x.lon - y.lon) + (x.lat - y.lat) * (x.lat - y.lat) AS d2
  FROM a x JOIN a y ON x.site = y.site WHERE x.golf = '{a}' AND y.golf = '{b}')"""  # noqa: E731
    words = lambda t: f"list_distinct(list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: w NOT IN ('', {', '.join(repr(w) for w in names.STOP_WORDS)})))"
    found = " + ".join(f"CASE WHEN contains({n}, '{w}') THEN {p}::DOUBLE ELSE 0 END" for w in QUERY.split() for n, p in (("lower(s_name)", 0.8), ("course", 0.6)))
    side = lambda m, p: f"sign(({m}.x1 - {m}.x0) * ({p[1]} - {m}.y0) - ({m}.y1 - {m}.y0) * ({p[0]} - {m}.x0))"
    apart = lambda m, n: f"{side(m, (f'{n}.x0', f'{n}.y0'))} * {side(m, (f'{n}.x1', f'{n}.y1'))} < 0"
    paint, pars = ", ".join(f"'{p}'" for p in PAINT), ", ".join(map(str, PARS))
    return {
        "greedy_one_to_one": f"""WITH RECURSIVE {pair("pin", "hole").removeprefix("WITH ")},
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d2, pin, hole) AS k FROM pr WHERE d2 <= CAST(0.02 AS DOUBLE) * CAST(0.02 AS DOUBLE)),
w AS (SELECT site, k, pin, hole, d2, true AS ok, [pin] AS ps, [hole] AS hs FROM o WHERE k = 1
  UNION ALL SELECT o.site, o.k, o.pin, o.hole, o.d2, NOT (list_contains(ps, o.pin) OR list_contains(hs, o.hole)),
    CASE WHEN list_contains(ps, o.pin) OR list_contains(hs, o.hole) THEN ps ELSE list_append(ps, o.pin) END, CASE WHEN list_contains(ps, o.pin) OR list_contains(hs, o.hole) THEN hs ELSE list_append(hs, o.hole) END
  FROM w JOIN o ON o.site = w.site AND o.k = w.k + 1)
SELECT site, pin, hole, round(d2, 9) AS d2 FROM w WHERE ok""",
        "nearest_within": f"""{pair("tee", "hole")} SELECT tee, hole, round(d2, 9) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY tee ORDER BY d2, hole) AS k FROM pr WHERE d2 < CAST(0.015 AS DOUBLE) * CAST(0.015 AS DOUBLE)) WHERE k = 1""",
        "self_crossings": f"""WITH p AS (SELECT o_orderkey AS id, ((o_orderkey % 100003) * (o_orderkey % 100019) % 1000003)::DOUBLE AS x0, ((o_orderkey % 100043) * (o_orderkey % 100049) % 1000003)::DOUBLE AS y0 FROM orders),
s AS (SELECT *, x0 + (id * 7919 % 6001 - 3000) AS x1, y0 + (id * 104729 % 6001 - 3000) AS y1 FROM p)
SELECT m.id AS a, n.id AS b FROM s m JOIN s n ON m.id < n.id AND abs(m.x0 - n.x0) <= 6000 AND abs(m.y0 - n.y0) <= 6000 WHERE {apart("m", "n")} AND {apart("n", "m")}""",
        "spatial_semi_clip": f"""WITH {assign.removeprefix("WITH ").split("p AS (")[0].rstrip().rstrip(",")}
SELECT feat FROM feats f WHERE EXISTS (SELECT 1 FROM boxes b WHERE boxed AND f.lon BETWEEN b.lon - CAST(0.02 AS DOUBLE) - CAST(0.0004 AS DOUBLE) AND b.lon + CAST(0.02 AS DOUBLE) + CAST(0.0004 AS DOUBLE)
  AND f.lat BETWEEN b.lat - CAST(0.02 AS DOUBLE) - CAST(0.0004 AS DOUBLE) AND b.lat + CAST(0.02 AS DOUBLE) + CAST(0.0004 AS DOUBLE))""",
        "name_jaccard": f"""SELECT p_partkey, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS score
FROM (SELECT p_partkey, {words("p_name")} AS x, {words("concat_ws(' ', p_type, p_brand, 'golf part')")} AS y FROM part)""",
        "hit_score_topk": f"""SELECT s_suppkey, round(CASE WHEN contains(lower(s_name), '{QUERY}') THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN contains(course, '{QUERY}') THEN 3.0::DOUBLE ELSE 0 END + {found}
  + CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN s_suppkey % 4 IN (0, 1) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE greatest(0.0, 2.0 - (s_suppkey % 37)::DOUBLE / 2.0 / 5.0) END, 6) AS score
FROM (SELECT *, 'the course ' || lpad((s_suppkey % 7)::VARCHAR, 2, '0') AS course FROM supplier) ORDER BY 2 DESC, 1 LIMIT 40""",
        "params_hash": "SELECT o_orderkey, substr(sha256('clubs/search?customer=' || o_custkey || '&status=' || url_encode(o_orderstatus)), 1, 24) AS key FROM orders",
        "ring_compactness": """SELECT p_partkey, round(w * h, 6) AS area, round(2 * (w + h), 6) AS perimeter, round(4 * pi() * w * h / (2 * (w + h)) ** 2, 6) AS compactness
FROM (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 7 + 1)::DOUBLE AS h FROM part)""",
        "chip_windows": """WITH i AS (SELECT p_partkey, p_size * 97 AS h, p_partkey % 11 * 211 AS w FROM part WHERE p_size > 0 AND p_partkey % 11 > 0),
y AS (SELECT DISTINCT p_partkey, unnest(list_append(generate_series(0, greatest(h - 512, 0), 384), greatest(h - 512, 0)))::BIGINT AS y FROM i), x AS (SELECT DISTINCT p_partkey, unnest(list_append(generate_series(0, greatest(w - 512, 0), 384), greatest(w - 512, 0)))::BIGINT AS x FROM i)
SELECT p_partkey, y, x FROM y JOIN x USING (p_partkey)""",
        "scorecard_lookup": f"SELECT hole, [{pars}][hole] AS par, [{pars}][(hole - 1) % 9 + 1] AS wrapped, n FROM (SELECT (l_partkey % 27 + 1)::INT AS hole, count(*) AS n FROM lineitem GROUP BY 1)",
        "bounds_mean": f"WITH {FEATURES_SQL} SELECT {layer} AS layer, " + ", ".join(f"round({g}({c}), 6) AS {n}_{c}" for n, g in (("min", "min"), ("max", "max"), ("mean", "avg")) for c in ("lon", "lat")) + " FROM feats GROUP BY 1",
        "validity_ratio": "SELECT l_returnflag, round(avg((l_quantity >= 10)::INT), 6) AS ratio FROM lineitem GROUP BY 1",
        "topology_counts": """SELECT count(*) FILTER (WHERE n IS NULL) AS holes_without_green, count(*) FILTER (WHERE c_custkey IS NOT NULL AND n > 1) AS holes_with_multiple_greens,
  coalesce(sum(n) FILTER (WHERE c_custkey IS NULL), 0)::BIGINT AS greens_without_hole FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
        "cache_ttl": "SELECT event_type, ts > now - INTERVAL 7 DAY AS fresh, count(*) AS n FROM events JOIN (SELECT event_type, max(ts) AS now FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2",
        "stream_counts": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2",
    }
