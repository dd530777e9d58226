"""Queries on regions grown from seeds, and their SQL. Marks are the places of orders, turf is all within one pixel of a mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import components, growth
from sitelens.sources.tables import table

#: Steps of the spreading, square and circle of parts and pins, widths and steps of growth along lines, in pixels.
STEPS, RADIUS, SNAP, SEARCH, START, SPINE, ALONG = 24, 12, 4, 10.0, 3.0, 2.0, 15


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), (k * 7919 % 211).alias("x"), F.floor(k / 64).cast("long").alias("y"))


def turf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.dilate(_marks(spark, sf_dir).select("x", "y").distinct(), 3).select(F.lit(0).cast("long").alias("key"), "x", "y")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins at the places of some orders."""
    return _marks(spark, sf_dir).where("k % 97 = 0").select(F.lit(0).cast("long").alias("key"), F.col("k").alias("seed"), "x", "y")


def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that each pin reaches first through the turf, by steps."""
    found = growth.spread(turf(spark, sf_dir), _seeds(spark, sf_dir), STEPS)
    return found.groupBy("seed", "step").agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def seed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the turf that each pin takes in its turn."""
    found = growth.claimed_parts(turf(spark, sf_dir).where("(x + y) % 9 > 1"), _seeds(spark, sf_dir), RADIUS)
    return found.groupBy("seed").agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def pin_turf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each pin by the colours around it."""
    x, y = F.col("x"), F.col("y")
    colours = {"r": 60 + (x * 31 + y * 17) % 40, "g": 110 + (x * 13 + y * 29) % 50, "b": 40 + (x + y) % 30}
    px = turf(spark, sf_dir).withColumns(colours).withColumn("veg", (F.col("g") - F.col("r")) / (F.col("g") + F.col("r")))
    px = px.withColumns({"sure": F.col("veg") > 0.35, "loose": F.col("veg") > 0.2})
    found = growth.pin_regions(px, _seeds(spark, sf_dir).withColumnRenamed("seed", "pin"), RADIUS, SNAP)
    return found.groupBy("pin").agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def line_turf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turf grown along lines from places of orders: sure where a third of the plane is, soft elsewhere."""
    k, x, y = F.col("k"), F.col("x"), F.col("y")
    lines = _marks(spark, sf_dir).where("k % 389 = 0").select(k.alias("key"), x.alias("ax"), y.alias("ay"), (x + k % 41 - 20).alias("bx"), (y + 30 * (k % 3 - 1)).alias("by"))
    t = turf(spark, sf_dir).select("x", "y")
    kind = (F.floor(x / 40) + F.floor(y / 50)) % 3 == 0
    found = growth.along_lines(lines, t.where(kind), t.where(~kind & (x % 5 > 0)), SEARCH, START, SPINE, ALONG)
    return found.groupBy(F.col("key").alias("line")).agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


QUERIES = {f.__name__: f for f in (seed_spread, seed_parts, pin_turf, line_turf)}

_TURF = "o AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 211 AS x, o_orderkey // 64 AS y FROM orders), t AS (SELECT DISTINCT x + i AS x, y + j AS y FROM o, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j))"
_STEPS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(i, j)"
_NINE = ", ".join(f"({i}, {j})" for i, j in growth.ellipse(9))
_SQUARE = ", ".join(f"({i}, {j})" for i, j in growth.SQUARE)
_BAND = "SELECT key, x, y FROM w WHERE (x + 0.5 - ax - t * (ex - ax)) ** 2 + (y + 0.5 - ay - t * (ey - ay)) ** 2 <= {0} * {0}"
# Parts and regions of pins have no SQL: a part depends on those of earlier pins; tests compare them with plain passes.
ORACLES = {
    "seed_spread": f"""WITH RECURSIVE {_TURF}, r AS (SELECT k AS seed, x, y, 0 AS step FROM o WHERE k % 97 = 0
  UNION SELECT r.seed, t.x, t.y, r.step + 1 FROM r, {_STEPS} JOIN t ON t.x = r.x + d.i AND t.y = r.y + d.j WHERE r.step < {STEPS}),
m AS (SELECT x, y, min((step, seed)) AS b FROM r GROUP BY ALL)
SELECT b[2] AS seed, b[1]::INT AS step, count(*) AS pixels, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM m GROUP BY ALL""",
    "line_turf": f"""WITH RECURSIVE {_TURF}, l AS (SELECT k AS key, x AS ax, y AS ay, x + k % 41 - 20 AS ex, y + 30 * (k % 3 - 1) AS ey FROM o WHERE k % 389 = 0),
n AS (SELECT *, unnest(range((least(ay, ey) - 11)::BIGINT, (greatest(ay, ey) + 12)::BIGINT)) AS y FROM (SELECT *, unnest(range((least(ax, ex) - 11)::BIGINT, (greatest(ax, ex) + 12)::BIGINT)) AS x FROM l)),
w AS (SELECT *, CASE WHEN ax = ex AND ay = ey THEN 0 ELSE least(greatest(((x + 0.5 - ax) * (ex - ax) + (y + 0.5 - ay) * (ey - ay)) / ((ex - ax) ** 2 + (ey - ay) ** 2), 0), 1) END AS t FROM n),
z AS ({_BAND.format(SEARCH)}), s AS ({_BAND.format(START)}), p AS ({_BAND.format(SPINE)}),
f AS (SELECT z.*, (floor(x / 40) + floor(y / 50)) % 3 = 0 AS sure FROM z JOIN t USING (x, y) WHERE (floor(x / 40) + floor(y / 50)) % 3 = 0 OR x % 5 > 0),
sn AS (SELECT key, count(*) AS n FROM s GROUP BY ALL),
e AS (SELECT key, count(*) FILTER (WHERE sure) >= greatest(40, floor(coalesce(any_value(n), 0) * 0.12)) AS enough FROM f LEFT JOIN sn USING (key) GROUP BY ALL),
a AS (SELECT key, x, y FROM f JOIN e USING (key) WHERE sure OR NOT enough), b AS (SELECT * FROM s SEMI JOIN a USING (key, x, y)),
many AS (SELECT key FROM b GROUP BY ALL HAVING count(*) >= 12),
g AS (SELECT *, 0 AS step FROM b SEMI JOIN many USING (key) UNION SELECT a.*, g.step + 1 FROM g, {_STEPS} JOIN a ON a.key = g.key AND a.x = g.x + d.i AND a.y = g.y + d.j WHERE g.step < {ALONG}),
h AS (SELECT p.* FROM p SEMI JOIN a USING (key, x, y) ANTI JOIN many USING (key) UNION SELECT a.* FROM h, (VALUES {_SQUARE}) d(i, j) JOIN a ON a.key = h.key AND a.x = h.x + d.i AND a.y = h.y + d.j),
u AS (SELECT DISTINCT key, x, y FROM g UNION ALL SELECT * FROM h SEMI JOIN (SELECT key FROM h GROUP BY ALL HAVING count(*) >= 12) USING (key)),
c AS (SELECT DISTINCT key, x + i AS x, y + j AS y FROM u, (VALUES {_NINE}) d(i, j)),
q AS (SELECT key, x - i AS x, y - j AS y FROM c, (VALUES {_NINE}) d(i, j) GROUP BY ALL HAVING count(*) = {len(growth.ellipse(9))})
SELECT key AS line, count(*) AS pixels, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM q SEMI JOIN a USING (key, x, y) GROUP BY ALL""",
}
