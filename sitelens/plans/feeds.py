"""Queries on feeds: adaptive tiles of regions, a ranking kept while files arrive, layered collections; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import formats, tags
from sitelens.operators import tiling
from sitelens.operators.completeness import WEIGHTS
from sitelens.plans.catalog import _shapes
from sitelens.sources import layered
from sitelens.sources.regions import GROUPS, REGIONS, regions, tiles
from sitelens.sources.scratch import scratch_path
from sitelens.sources.tables import FEATURES_SQL, features, sites
from sitelens.streaming.ranking import rank_arrivals

STEP, CAPACITY, FILES = 0.25, 150, 5


def region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 4 degrees of the regions of each group, and the features in them."""
    named = [regions(spark, g).withColumn("region", F.concat_ws(":", F.lit(g), "region")) for g in (*GROUPS, "lisbon", "portugal")]
    every = named[0]
    for n in named[1:]:
        every = every.unionByName(n)
    t = tiles(every, 4.0)
    held = tiling.in_tiles(features(spark, sf_dir).select("lon", "lat"), every, 4.0).groupBy("region", "i", "j").agg(F.count("*").alias("n"))
    out = t.join(held, ["region", "i", "j"], "left").fillna(0, ["n"])
    return out.select("region", "i", "j", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")], "n")


def adaptive_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the quartered tiles of one region that hold features."""
    placed = tiling.in_tiles(features(spark, sf_dir).select("lon", "lat"), regions(spark, "portugal"), STEP)
    return tiling.leaves(placed, CAPACITY).drop("region")


def adaptive_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of one region with what their quarters found, merged, and the boxes asked for."""
    placed = tiling.in_tiles(features(spark, sf_dir).select("lon", "lat"), regions(spark, "portugal"), STEP)
    return tiling.merged(placed, CAPACITY).drop("region")


def arriving_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites ranked by a stream over files of elements, dealt by longitude; the last recount."""
    s = sites(spark, sf_dir)
    f = features(spark, sf_dir).select("feat", "lon", "lat", tags.golf_layer(F.col("golf")).alias("layer"), "way")
    folder = scratch_path(spark, "elements")
    s.unionByName(f, allowMissingColumns=True).repartitionByRange(FILES, "lon").write.parquet(folder)
    state, batches = rank_arrivals(spark, folder)
    points = [f"points_{k}" for k in WEIGHTS]
    r = state.final(batches)
    return r.select("site", F.col("expected").cast("long").alias("expected"), "score", "flags", F.col("fringe").alias("fringes"), "putting_green", "tee_ways", *points, F.col("rank").cast("long").alias("rank"))


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as collections of their layers and read back: number and ids of each layer."""
    s = _shapes(spark, sf_dir).where("layer IS NOT NULL")
    rows = s.select("layer", formats.geojson(F.col("kind"), F.col("points"), F.col("layer"), F.initcap("layer"), {"feat": F.col("feat")}).alias("feature"))
    path = scratch_path(spark, "layers")
    layered.write_layers(rows, path)
    feat = F.get_json_object("feature", "$.properties.feat").cast("long")
    back = layered.read_layers(spark, path).select("layer", F.get_json_object("feature", "$.geometry.type").alias("kind"), feat.alias("feat"))
    return back.groupBy("layer", "kind").agg(F.count("*").alias("n"), F.min("feat").alias("first"), F.max("feat").alias("last"), F.sum("feat").cast("long").alias("total"))


QUERIES = {f.__name__: f for f in (region_tiles, adaptive_tiles, adaptive_requests, arriving_ranking, layer_files)}


def _boxes(members: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{name}', {', '.join(f'{v}::DOUBLE' for v in REGIONS[r])})" for name, r in members) + ") t(region, west, south, east, north)"


_GROUPED = [(f"{g}:{r}", r) for g, rs in (*GROUPS.items(), ("lisbon", ["lisbon"]), ("portugal", ["portugal"])) for r in rs]
_PLACED = f"""{FEATURES_SQL}, b AS (FROM {_boxes([("portugal", "portugal")])}),
t AS (SELECT lon, lat, west, south, east, north, least(floor((lon - west) / {STEP}), ceil((east - west - 1e-12) / {STEP}) - 1)::INT AS i, least(floor((lat - south) / {STEP}), ceil((north - south - 1e-12) / {STEP}) - 1)::INT AS j
  FROM feats, b WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north),
w AS (SELECT i, j, least(floor((lon - (west + i * {STEP})) / (least(west + i * {STEP} + {STEP}, east) - (west + i * {STEP})) * 8), 7)::INT AS x, least(floor((lat - (south + j * {STEP})) / (least(south + j * {STEP} + {STEP}, north) - (south + j * {STEP})) * 8), 7)::INT AS y FROM t),
l0 AS (SELECT i, j, 0 AS level, 0 AS lx, 0 AS ly, count(*) AS n FROM w GROUP BY ALL),
l1 AS (SELECT i, j, 1 AS level, x // 4 AS lx, y // 4 AS ly, count(*) AS n FROM w GROUP BY ALL),
l2 AS (SELECT i, j, 2 AS level, x // 2 AS lx, y // 2 AS ly, count(*) AS n FROM w GROUP BY ALL),
l3 AS (SELECT i, j, 3 AS level, x AS lx, y AS ly, count(*) AS n FROM w GROUP BY ALL),
v AS (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3),
k AS (SELECT * FROM v WHERE (n <= {CAPACITY} OR level = 3) AND (level = 0 OR EXISTS (FROM v p WHERE p.i = v.i AND p.j = v.j AND p.level = v.level - 1 AND p.lx = v.lx // 2 AND p.ly = v.ly // 2 AND p.n > {CAPACITY})))"""


def oracles(rank_sql: str, layer: str) -> dict[str, str]:
    return {
        "region_tiles": f"""WITH {FEATURES_SQL}, b AS (FROM {_boxes(_GROUPED)}),
t AS (SELECT *, unnest(range(0, ceil((north - south - 1e-12) / 4)::INT)) AS j FROM (SELECT *, unnest(range(0, ceil((east - west - 1e-12) / 4)::INT)) AS i FROM b)),
n AS (SELECT region, least(floor((lon - west) / 4), ceil((east - west - 1e-12) / 4) - 1) AS i, least(floor((lat - south) / 4), ceil((north - south - 1e-12) / 4) - 1) AS j, count(*) AS n FROM feats, b WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY ALL)
SELECT t.region, t.i::INT AS i, t.j::INT AS j, round(west + t.i * 4, 6) AS west, round(south + t.j * 4, 6) AS south, round(least(west + (t.i + 1) * 4, east), 6) AS east, round(least(south + (t.j + 1) * 4, north), 6) AS north, coalesce(n.n, 0) AS n
FROM t LEFT JOIN n ON n.region = t.region AND n.i = t.i AND n.j = t.j""",
        "adaptive_tiles": f"WITH {_PLACED} SELECT i, j, level, lx, ly, n, n > {CAPACITY} AS full FROM k",
        "adaptive_requests": f"""WITH {_PLACED}, q AS (SELECT i, j, count(*) AS splits FROM v WHERE level < 3 AND n > {CAPACITY} GROUP BY ALL)
SELECT k.i, k.j, sum(k.n)::BIGINT AS n, count(*) AS leaves, 1 + 4 * coalesce(any_value(splits), 0) AS asked, count(*) FILTER (WHERE k.n > {CAPACITY}) AS full FROM k LEFT JOIN q ON q.i = k.i AND q.j = k.j GROUP BY k.i, k.j""",
        "arriving_ranking": rank_sql,
        "layer_files": f"""WITH {FEATURES_SQL}, l AS (SELECT feat, {layer} AS layer FROM feats)
SELECT layer, CASE layer WHEN 'hole_centerline' THEN 'LineString' WHEN 'pin' THEN 'Point' ELSE 'Polygon' END AS kind, count(*) AS n, min(feat) AS first, max(feat) AS last, sum(feat)::BIGINT AS total FROM l WHERE layer IS NOT NULL GROUP BY ALL""",
    }
