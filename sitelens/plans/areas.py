"""Queries on areas of concave and holed shapes, and their SQL: there a shape is the set of its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import rings
from sitelens.operators import areas, overlay, raster
from sitelens.plans.assignment import PAINT
from sitelens.sources.tables import table

#: Tiles of the overlay and width of buffers, in cells; grid units of a cell where corners become arcs.
TILE, WIDTH, FINE = 64, 9.1**0.5, 1000


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, site, side, x0, y0 and ring, hole of each order's shape: an L, a U or a box with a hole (two rows)."""
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_custkey").alias("site"), (_long(k / 3) % 2).cast("int").alias("side"), (k % 3).alias("kind"), (k % 8 + 4).alias("w"), (_long(k / 8) % 8 + 4).alias("h"), (k * 7919 % 37).alias("x0"), (k * 104729 % 31).alias("y0")
    )
    w, h, zero = F.col("w"), F.col("h"), F.lit(0)
    w2, h2, w3 = _long(w / 2), _long(h / 2), _long(w / 3)

    def ring(*points: tuple[Column, Column]) -> Column:
        return F.array(*[F.struct((F.col("x0") + x).cast("long").alias("x"), (F.col("y0") + y).cast("long").alias("y")) for x, y in points])

    ell = ring((zero, zero), (w, zero), (w, h2), (w2, h2), (w2, h), (zero, h))
    you = ring((zero, zero), (w, zero), (w, h), (w - w3, h), (w - w3, h2), (w3, h2), (w3, h), (zero, h))
    box = ring((zero, zero), (w, zero), (w, h), (zero, h))
    one = F.lit(1)
    inner = ring((one, one), (w - 1, one), (w - 1, h - 1), (one, h - 1))
    of = lambda r, hole: F.struct(r.alias("ring"), F.lit(hole).alias("hole"))
    parts = F.when(F.col("kind") == 0, F.array(of(ell, False))).when(F.col("kind") == 1, F.array(of(you, False))).otherwise(F.array(of(box, False), of(inner, True)))
    return s.select("k", "site", "side", "x0", "y0", F.explode(parts).alias("p")).select("k", "site", "side", "x0", "y0", "p.ring", "p.hole")


def _measures(result: DataFrame, key: str, *by: str) -> DataFrame:
    """Area and length of all rings of a key; holes turn the other way, so their areas are negative."""
    m = overlay.measured(result, "key", *by).groupBy("key", *by).agg(F.sum("area").alias("a"), F.sum("border").alias("p"))
    return m.select(F.col("key").alias(key), F.round("a").cast("long").alias("area"), F.round("p").cast("long").alias("border"), *by)


def site_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of the two kinds of shapes of each site: area and length of border."""
    s = shapes(spark, sf_dir).withColumn("key", F.col("site"))
    return _measures(areas.all_combined(s.where("side = 0"), s.where("side = 1"), ["union", "intersection", "difference"], TILE), "site", "operation")


def layer_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shape per layer out of all its shapes: area and length of border."""
    k = F.col("k")
    moved = F.transform("ring", lambda p: F.struct((p.x + k * 15485863 % 3000).alias("x"), (p.y + k * 32452843 % 3000).alias("y")))
    s = shapes(spark, sf_dir).select((k % 8).alias("key"), moved.alias("ring"), "hole")
    return _measures(areas.dissolve(s, TILE), "layer")


def _box(name: str) -> list[Column]:
    return [f(F.col("ring")[c]).alias(f"{name}_{c}{k}") for k, f in enumerate((F.array_min, F.array_max)) for c in "xy"]


def _meet(reach: float = 0) -> Column:
    """Whether the boxes of a, widened by the reach, and b share more than a side: no other shape takes anything off."""
    a, b = ({c: F.col(f"{n}_{c}") for c in ("x0", "y0", "x1", "y1")} for n in "ab")
    return (a["x0"] - reach < b["x1"]) & (b["x0"] < a["x1"] + reach) & (a["y0"] - reach < b["y1"]) & (b["y0"] < a["y1"] + reach)


def layer_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other kind's shapes of a site leave of each of its shapes: area and border of those that stay."""
    s = shapes(spark, sf_dir)
    own = s.where("side = 0").withColumn("key", F.col("k"))
    others = s.where("side = 1").select("site", "ring", "hole", *_box("b"))
    # outer rings only: their holes lie within them
    mask = own.where("NOT hole").select("key", "site", *_box("a")).join(others, "site").where(_meet()).select("key", "ring", "hole")
    return _measures(areas.subtracted(own, mask, TILE), "shape")


def _greens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).where("k % 12 < 3").select(F.col("k").alias("key"), "site", "ring", "hole")


def _fine(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", F.transform("ring", lambda p: F.struct((p.x * FINE).alias("x"), (p.y * FINE).alias("y"))))


def _cells(result: DataFrame, name: str) -> DataFrame:
    """Number of cells whose middles lie in each key's rings."""
    found = raster.pixels_of(result.select("key", overlay.unsnapped(F.col("ring"), FINE).alias("ring")))
    return found.groupBy(F.col("key").alias("shape")).agg(F.count("*").alias("cells")).withColumn("what", F.lit(name))


def shape_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greens grown and shrunk by the width: cells whose middles lie inside."""
    g = _fine(_greens(spark, sf_dir))
    grown, shrunk = (areas.buffered(g, width * FINE, TILE * FINE) for width in (WIDTH, -1.1))
    return _cells(grown, "grown").unionByName(_cells(shrunk, "shrunk"))


def green_collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collar of each green without any shape of its site: cells whose middles lie in it."""
    every = _fine(shapes(spark, sf_dir).select("site", "ring", "hole"))
    every = every.select("*", *_box("b"))
    g = _fine(_greens(spark, sf_dir))
    beside = lambda own: own.where("NOT hole").select("key", "site", *_box("a")).join(every, "site").where(_meet(WIDTH * FINE + 1)).select("key", "ring", "hole")
    found = areas.collars(g, WIDTH * FINE, beside, TILE * FINE)
    return _cells(found, "collar").drop("what")


def label_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each class: a site's shapes painted in the order of classes, the last one over a pixel stays."""
    turn = F.col("k") % len(PAINT)
    px = raster.painted(shapes(spark, sf_dir).select(F.col("site").alias("key"), F.col("k").alias("shape"), turn.alias("turn"), "ring"))
    return px.groupBy(F.element_at(F.array(*[F.lit(p) for p in PAINT]), F.col("turn").cast("int") + 1).alias("class")).agg(F.count("*").alias("pixels"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((k % 4).alias("key"), (k * 7919 % 211).alias("x"), _long(k / 64).alias("y")).distinct()


def mask_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of four masks of pixels: area, length and number of corners of all."""
    r = raster.mask_rings(_marks(spark, sf_dir))
    corners = r.groupBy(F.col("key").alias("mask")).agg(F.sum(F.size("ring")).cast("long").alias("corners"))
    return _measures(r, "mask").join(corners, "mask")


QUERIES = {f.__name__: f for f in (site_overlays, layer_dissolve, layer_subtraction, shape_buffers, green_collars, label_paint, mask_outlines)}

_SHAPES = """s AS (SELECT o_orderkey AS k, o_custkey AS site, o_orderkey // 3 % 2 AS side, o_orderkey % 3 AS kind, o_orderkey % 8 + 4 AS w, o_orderkey // 8 % 8 + 4 AS h,
  o_orderkey * 7919 % 37 AS x0, o_orderkey * 104729 % 31 AS y0 FROM orders),
every AS (SELECT *, unnest(range(-5, h + 5)) AS j FROM (SELECT *, unnest(range(-5, w + 5)) AS i FROM s)),
flagged AS (SELECT *, x0 + i AS x, y0 + j AS y, i >= 0 AND i < w AND j >= 0 AND j < h AND NOT CASE kind WHEN 0 THEN i >= w // 2 AND j >= h // 2
  WHEN 1 THEN i >= w // 3 AND i < w - w // 3 AND j >= h // 2 ELSE i >= 1 AND i < w - 1 AND j >= 1 AND j < h - 1 END AS held FROM every),
c AS (SELECT k, site, side, x, y FROM flagged WHERE held)"""


def _border(cells: str, *keys: str) -> str:
    """Area and border of the sets of distinct cells: four sides each, less two where neighbours meet."""
    by = ", ".join(keys)
    same = lambda dx, dy: f"SELECT {', '.join(f'a.{k}' for k in keys)}, count(*) AS n FROM {cells} a JOIN {cells} b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} AND b.x = a.x + {dx} AND b.y = a.y + {dy} GROUP BY ALL"
    return f"""SELECT {by}, area, (4 * area - 2 * coalesce(m.n, 0))::BIGINT AS border FROM (SELECT {by}, count(*) AS area FROM {cells} GROUP BY ALL)
LEFT JOIN (SELECT {by}, sum(n) AS n FROM ({same(1, 0)} UNION ALL {same(0, 1)}) GROUP BY ALL) m USING ({by})"""


# cells of a shape's window whose box lies within a distance of a cell's middle, both in the window's coordinates
_NEAR = "greatest(abs(a.i - b.i) - 0.5, 0) ** 2 + greatest(abs(a.j - b.j) - 0.5, 0) ** 2"
ORACLES = {
    "site_overlays": f"""WITH {_SHAPES}, d AS (SELECT DISTINCT site, side, x, y FROM c), m AS (SELECT site, x, y, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM d GROUP BY ALL),
o AS (SELECT site, 'union' AS operation, x, y FROM m UNION ALL SELECT site, 'intersection', x, y FROM m WHERE a AND b UNION ALL SELECT site, 'difference', x, y FROM m WHERE a AND NOT b)
{_border("o", "site", "operation")}""",
    "layer_dissolve": f"""WITH {_SHAPES}, o AS (SELECT DISTINCT k % 8 AS layer, x + k * 15485863 % 3000 AS x, y + k * 32452843 % 3000 AS y FROM c) {_border("o", "layer")}""",
    "layer_subtraction": f"""WITH {_SHAPES}, o AS (SELECT k AS shape, x, y FROM c a WHERE side = 0 AND NOT EXISTS (FROM c b WHERE b.side = 1 AND b.site = a.site AND b.x = a.x AND b.y = a.y)) {_border("o", "shape")}""",
    "shape_buffers": f"""WITH {_SHAPES}, g AS (SELECT * FROM flagged WHERE k % 12 < 3)
SELECT k AS shape, count(*) AS cells, 'grown' AS what FROM (SELECT DISTINCT a.k, a.i, a.j FROM g a JOIN g b ON a.k = b.k AND b.held WHERE {_NEAR} <= 9.1) GROUP BY ALL
UNION ALL SELECT k, count(*), 'shrunk' FROM g a WHERE held AND NOT EXISTS (FROM g b WHERE a.k = b.k AND NOT b.held AND {_NEAR} < 1.21) GROUP BY ALL""",
    "green_collars": f"""WITH {_SHAPES}, g AS (SELECT * FROM flagged WHERE k % 12 < 3),
n AS (SELECT DISTINCT a.k, a.site, a.x, a.y FROM g a JOIN g b ON a.k = b.k AND b.held WHERE {_NEAR} <= 9.1)
SELECT k AS shape, count(*) AS cells FROM n WHERE NOT EXISTS (FROM c WHERE c.site = n.site AND c.x = n.x AND c.y = n.y) GROUP BY ALL""",
    "label_paint": f"""WITH {_SHAPES}, p AS (SELECT site, x, y, max(k % {len(PAINT)}) AS turn FROM c GROUP BY ALL) SELECT [{', '.join(f"'{p}'" for p in PAINT)}][turn + 1] AS class, count(*) AS pixels FROM p GROUP BY ALL""",
    "mask_outlines": f"""WITH o AS (SELECT DISTINCT o_orderkey % 4 AS mask, o_orderkey * 7919 % 211 AS x, o_orderkey // 64 AS y FROM orders),
v AS (SELECT mask, x + dx AS x, y + dy AS y, sum(1 << (dx + 2 * dy)) AS around FROM o, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy) GROUP BY ALL),
n AS (SELECT mask, sum(CASE WHEN around IN (1, 2, 4, 8, 7, 11, 13, 14) THEN 1 WHEN around IN (6, 9) THEN 2 ELSE 0 END)::BIGINT AS corners FROM v GROUP BY ALL)
SELECT * FROM ({_border("o", "mask")}) JOIN n USING (mask)""",
}
