"""Queries on the given tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions import names, tags
from sitelens.operators import completeness, spatial
from sitelens.plans import areas, assignment, catalog, drafting, feeds, fusing, images, refining, turf
from sitelens.sources.tables import FEATURES_SQL, SITES_SQL, features, sites, table

_GOLF = ", ".join(f"'{k}': '{v}'" for k, v in tags.GOLF_LAYERS.items())
_LAYER_SQL = f"list_filter(list_transform(string_split(golf, ';'), lambda p: MAP {{{_GOLF}}}[trim(p)]), lambda x: x IS NOT NULL)[1]"


def tag_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy(tags.golf_layer(F.col("golf")).alias("layer"), "way").agg(F.count("*").alias("n"))


def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.assign_to_sites(features(spark, sf_dir).select("feat", "lon", "lat"), sites(spark, sf_dir))
    return found.select("feat", "site", F.round("d2", 9).alias("d2"))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).select("feat", "lon", "lat", tags.golf_layer(F.col("golf")).alias("layer"), "way")
    s = sites(spark, sf_dir)
    return completeness.ranked(s, spatial.assign_to_sites(f, s))


def completeness_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by completeness with the points of each term."""
    points = [f"points_{k}" for k in completeness.WEIGHTS]
    return ranking(spark, sf_dir).select("site", F.col("expected").cast("long").alias("expected"), "score", "flags", F.col("fringe").alias("fringes"), "putting_green", "tee_ways", *points, F.col("rank").cast("long").alias("rank"))


def top_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best sites with 20 points or more that are neither small nor ranges (a top-k report)."""
    return completeness.training_rows(ranking(spark, sf_dir), 100, 20.0).select(F.col("rank").cast("long").alias("rank"), "site", "score")


_ASSIGN_SQL = f"""WITH {SITES_SQL}, {FEATURES_SQL},
p AS (SELECT f.*, s.site, (f.lon - s.lon) * (f.lon - s.lon) + (f.lat - s.lat) * (f.lat - s.lat) AS d2,
  boxed AND f.lon BETWEEN s.lon + CAST(-0.02 AS DOUBLE) AND s.lon + CAST(0.02 AS DOUBLE) AND f.lat BETWEEN s.lat + CAST(-0.02 AS DOUBLE) AND s.lat + CAST(0.02 AS DOUBLE) AS inside
  FROM feats f JOIN boxes s ON f.lon BETWEEN s.lon - 0.04 AND s.lon + 0.04 AND f.lat BETWEEN s.lat - 0.04 AND s.lat + 0.04),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY inside DESC, d2, site) AS k FROM p WHERE inside OR d2 <= CAST(0.03 AS DOUBLE) * CAST(0.03 AS DOUBLE)) WHERE k = 1)"""
_TERMS = {k: f"least({k} / {'expected' if k in ('green', 'fairway', 'tee', 'hole', 'pin') else 'greatest(6, 0.75 * expected)' if k == 'bunker' else 1}, 1)" for k in completeness.WEIGHTS if k != "named"} | {"named": "CASE WHEN trim(coalesce(name, '')) = '' THEN 0 ELSE 1 END"}
_LAYERS = {v: ", ".join(f"'{k}'" for k, x in completeness.COUNTERS.items() if x == v) for v in completeness.NAMES}
_SMALL = f"(list_has_any(list_transform(string_split(lower(coalesce(kind, '')), ';'), lambda x: trim(x)), {completeness.SMALL_KINDS}) OR " + " OR ".join(f"contains(lower(coalesce(name, '')), '{w}')" for w in completeness.SMALL_NAMES) + ")"
_RANK_SQL = f"""{_ASSIGN_SQL},
l AS (SELECT *, {_LAYER_SQL} AS layer FROM a),
c AS (SELECT s.site, s.name, s.holes, s.kind, {', '.join(f"count(*) FILTER (WHERE layer IN ({x})) AS {v}" for v, x in _LAYERS.items())},
  {', '.join(f"count(*) FILTER (WHERE layer IN ({_LAYERS[v]}) AND way) AS {v}_ways" for v in completeness.WAYS)}
  FROM sites s LEFT JOIN l USING (site) GROUP BY s.site, s.name, s.holes, s.kind),
e AS (SELECT *, CASE WHEN t IN (9, 18, 27, 36) THEN t WHEN h >= 33 THEN 36 WHEN h >= 24 THEN 27 WHEN h >= 14 THEN 18 WHEN h >= 7 THEN 9 ELSE 18 END AS expected
  FROM (SELECT *, greatest(green, hole, fairway, green_ways, hole_ways) AS h, trunc(try_cast(trim(holes) AS DOUBLE))::INT AS t FROM c)),
r AS (SELECT *, {', '.join(f"round(({w} * {_TERMS[k]})::DOUBLE, 3) AS points_{k}" for k, w in completeness.WEIGHTS.items())}, ({' + '.join(f"{w} * {_TERMS[k]}" for k, w in completeness.WEIGHTS.items())})
  * CASE WHEN green_ways = 0 AND green > 0 THEN 0.85 ELSE 1 END * CASE WHEN {_SMALL} THEN 0.35 ELSE 1 END * CASE WHEN green = 0 AND driving_range > 0 THEN 0.3 ELSE 1 END AS raw FROM e),
q AS (SELECT site, name, green, expected::BIGINT AS expected, round(least(greatest(raw, 0), 100)::DOUBLE, 3) AS score,
  concat_ws(';', CASE WHEN green_ways = 0 AND green > 0 THEN 'green_nodes_only' END, CASE WHEN green < expected * 0.5 THEN 'incomplete_core' END, CASE WHEN trim(coalesce(name, '')) = '' THEN 'unnamed' END,
  CASE WHEN {_SMALL} THEN 'miniature' END, CASE WHEN green = 0 AND driving_range > 0 THEN 'driving_range_only' END, CASE WHEN green = 0 AND fairway = 0 AND hole = 0 THEN 'boundary_only' END) AS flags,
  fringe AS fringes, putting_green, tee_ways, {', '.join(f"points_{k}" for k in completeness.WEIGHTS)} FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, green DESC, lower(trim(coalesce(name, ''))) DESC, site) AS rank FROM q)"""
_ORACLE_RANK = f"{_RANK_SQL} SELECT * EXCLUDE (name, green) FROM k"


def origin_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a user's features come from: one origin, several (mixed)."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("k"), F.min("event_type").alias("one"))
    return e.groupBy(F.when(F.col("k") > 1, "mixed").otherwise(F.col("one")).alias("origin")).agg(F.count("*").alias("users"))


def coerce_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy(F.when(k.isNull(), "none").when(k < 50, "low").otherwise("high").alias("band")).agg(F.count("*").alias("n"), F.sum(k).cast("long").alias("total"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train or val by the hash of type:id, the same at every run."""
    f = features(spark, sf_dir)
    return f.select("feat", names.split(F.when(F.col("way"), "way").otherwise("node"), F.col("feat")).alias("split"))


def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the last event of that user, NULL if none."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.event_id", "m.event_type")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return c.join(e, "user_id", "left").select("user_id", "event_id", "event_type")


def lead_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive orders of a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"))
    return o.where("b IS NOT NULL")


def way_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from their nodes in order, with whether they close."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    n = n.select(F.col("l_orderkey").alias("way"), F.transform("x", lambda s: s.l_partkey).alias("nodes"))
    closed = (F.size("nodes") >= 4) & (F.element_at("nodes", 1) == F.element_at("nodes", -1))
    return n.select("way", F.array_join(F.transform("nodes", lambda i: i.cast("string")), ",").alias("nodes"), F.size("nodes").cast("long").alias("n"), closed.alias("closed"))


def pin_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two feature sets by key, the first one's values winning."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("x"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("y"))
    return a.join(b, "k", "full").select("k", F.coalesce("x", "y").alias("name"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), "both").when(F.col("x").isNotNull(), "first").otherwise("second").alias("origin"))


def class_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (orders) on which at least two of the sources (lines) agree."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("votes")).where("votes >= 2")
    best = F.max(F.struct("votes", F.col("l_returnflag").alias("class"))).alias("b")
    return v.groupBy("l_orderkey").agg(best).select("l_orderkey", "b.class", "b.votes")


def tile_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features per web-map tile at zoom 12."""
    f = features(spark, sf_dir)
    lat = F.radians("lat")
    y = (F.lit(1.0) - F.log(F.tan(lat) + F.lit(1.0) / F.cos(lat)) / F.lit(3.141592653589793)) / F.lit(2.0) * F.lit(4096.0)
    x = (F.col("lon") + F.lit(180.0)) / F.lit(360.0) * F.lit(4096.0)
    return f.groupBy(F.floor(x).cast("long").alias("x"), F.floor(y).cast("long").alias("y")).agg(F.count("*").alias("n"))


def texture_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", F.lit(0.55)), 6).alias("p55"))


def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value kept for each user and type."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return e.select("user_id", "event_type", "m.event_id", F.round("m.value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (tag_classify, grid_assign, completeness_rank, top_training_rows, origin_buckets, coerce_json, hash_split, latest_job, lead_edges, way_assembly, pin_coalesce, class_vote, tile_math, texture_percentile, cache_latest)}
ORACLES = {
    "tag_classify": f"WITH {FEATURES_SQL} SELECT {_LAYER_SQL} AS layer, way, count(*) AS n FROM feats GROUP BY 1, 2",
    "grid_assign": f"{_ASSIGN_SQL} SELECT feat, site, round(d2, 9) AS d2 FROM a",
    "completeness_rank": _ORACLE_RANK,
    "top_training_rows": f"{_RANK_SQL} SELECT rank, site, score FROM k WHERE NOT contains(flags, 'miniature') AND NOT contains(flags, 'driving_range_only') AND score >= 20 ORDER BY rank LIMIT 100",
    "origin_buckets": "SELECT CASE WHEN k > 1 THEN 'mixed' ELSE one END AS origin, count(*) AS users FROM (SELECT user_id, count(DISTINCT event_type) AS k, min(event_type) AS one FROM events GROUP BY 1) GROUP BY 1",
    "coerce_json": "SELECT CASE WHEN k IS NULL THEN 'none' WHEN k < 50 THEN 'low' ELSE 'high' END AS band, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1",
    "hash_split": f"""WITH {FEATURES_SQL} SELECT feat, CASE WHEN ('0x' || substr(sha1(CASE WHEN way THEN 'way:' ELSE 'node:' END || feat), 1, 8))::BIGINT::DOUBLE / 4294967295 < 0.15 THEN 'val' ELSE 'train' END AS split FROM feats""",
    "latest_job": "SELECT c_custkey AS user_id, event_id, event_type FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) e ON user_id = c_custkey AND k = 1",
    "lead_edges": "SELECT * FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL",
    "way_assembly": "SELECT l_orderkey AS way, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS nodes, count(*) AS n, count(*) >= 4 AND first(l_partkey ORDER BY l_linenumber, l_partkey) = last(l_partkey ORDER BY l_linenumber, l_partkey) AS closed FROM lineitem GROUP BY 1",
    "pin_coalesce": "SELECT coalesce(c_custkey, s_suppkey * 3) AS k, coalesce(c_name, s_name) AS name, CASE WHEN c_name IS NOT NULL AND s_name IS NOT NULL THEN 'both' WHEN c_name IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3",
    "class_vote": "SELECT l_orderkey, l_returnflag AS class, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, l_returnflag DESC) AS k FROM (SELECT l_orderkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2)) WHERE k = 1",
    "tile_math": f"WITH {FEATURES_SQL} SELECT floor((lon + 180) / 360 * 4096)::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS y, count(*) AS n FROM feats GROUP BY 1, 2",
    "texture_percentile": "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.55), 6) AS p55 FROM lineitem GROUP BY 1",
    "cache_latest": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
}

QUERIES |= assignment.QUERIES | catalog.QUERIES | drafting.QUERIES | areas.QUERIES | feeds.QUERIES | turf.QUERIES | fusing.QUERIES | images.QUERIES | refining.QUERIES
ORACLES |= assignment.oracles(_ASSIGN_SQL, _LAYER_SQL) | catalog.oracles(_ASSIGN_SQL, _LAYER_SQL) | drafting.oracles(_ASSIGN_SQL, _LAYER_SQL) | areas.ORACLES | feeds.oracles(_ORACLE_RANK, _LAYER_SQL) | turf.ORACLES | fusing.oracles(_ASSIGN_SQL) | images.ORACLES | refining.oracles(_ASSIGN_SQL)
