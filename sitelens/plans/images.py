"""Queries on images, and their SQL. Parts are the pixels of one image, patches of five colours with noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import growth
from sitelens.operators import pixel_classes as pc
from sitelens.sources.tables import table

WIDTH = 50
#: Colours of patches: water, sand, green, fairway, dry grass.
COLOURS = [(8, 10, 12), (215, 190, 140), (70, 150, 60), (95, 120, 70), (140, 136, 95)]


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    px = table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("key"), (k % WIDTH).alias("x"), F.floor(k / WIDTH).cast("long").alias("y"))
    patch = (F.floor(F.col("x") / 13) * 2 + F.floor(F.col("y") / 11)) % len(COLOURS)
    noise = (F.col("x") * 31 + F.col("y") * 17 + F.col("x") * F.col("y")) % 7
    colour = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in COLOURS]), (patch + 1).cast("int")) + noise * (n + 1) % 5
    return px.withColumns({name: colour(n).cast("int") for n, name in enumerate("rgb")})


def pixel_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each class; sand and greens are expected in places, some columns are cart paths, some rows excluded."""
    px = _image(spark, sf_dir)
    kind = F.when(F.col("x") % 17 == 3, "cart_path").when(F.col("y") % 23 == 5, "exclude").when((F.col("x") + F.col("y")) % 6 == 0, "green").when((F.col("x") + F.col("y")) % 6 == 1, "bunker")
    found = pc.classes(px, px.select("key", "x", "y", kind.alias("kind")).where("kind IS NOT NULL"))
    each = found.select("x", "y", F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in pc.KERNELS])).alias("class")).where("class IS NOT NULL")
    return each.groupBy("class").agg(F.count("*").alias("pixels"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


def pixel_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture, hue, saturation and lightness of each pixel."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    (h, s, v), (light, a) = pc.hsv(r, g, b), pc.lab(r, g, b)
    return pc.textured(_image(spark, sf_dir)).select("x", "y", F.round("tex", 6).alias("tex"), *[c.cast("long").alias(n) for n, c in (("h", h), ("s", s), ("v", v), ("light", light), ("a", a))])


QUERIES = {f.__name__: f for f in (pixel_classes, pixel_texture)}


def _morphed(name: str, a: int, b: int) -> str:
    """Common tables of a class opened and closed within the image."""
    out, last = [], f"(SELECT x, y, {name} AS c FROM f)"
    for n, (k, how) in enumerate(((a, "and"), (a, "or"), (b, "or"), (b, "and"))):
        steps = ", ".join(f"({i}, {j})" for i, j in growth.ellipse(k))
        out.append(f"{name}{n} AS (SELECT i.x, i.y, bool_{how}(n.c) AS c FROM {last} i, (VALUES {steps}) d(i, j) JOIN {last} n ON n.x = i.x + d.i AND n.y = i.y + d.j GROUP BY ALL)")
        last = f"{name}{n}"
    return ", ".join(out)


def _window(weights, value: str, source: str, extra: str) -> str:
    """Weighted sum of a value around each pixel, mirrored at the edges."""
    r = len(weights) // 2
    steps = ", ".join(f"({k - r}, {w})" for k, w in enumerate(weights))
    return f"SELECT i.x, i.y, {extra}, sum(a.w * b.w * n.{value}) AS s FROM {source} i, m, (VALUES {steps}) a(d, w), (VALUES {steps}) b(d, w) JOIN {source} n ON n.x = mx - abs(mx - abs(i.x + a.d)) AND n.y = my - abs(my - abs(i.y + b.d)) GROUP BY ALL"


_COLOUR = lambda n: f"({[c[n] for c in COLOURS]})[patch + 1] + noise * {n + 1} % 5"
_FLAT = lambda c: f"CASE WHEN {c} > 0.04045 * 255 THEN (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4::DOUBLE ELSE {c} / (255.0::DOUBLE * 12.92) END"
_ROOT = lambda t: f"CASE WHEN {t} > 0.008856 THEN {t} ** (1.0::DOUBLE / 3) ELSE {t} * 7.787 + 16.0::DOUBLE / 116 END"
_PIXELS = f"""p AS (SELECT x, y, {_COLOUR(0)} AS r, {_COLOUR(1)} AS g, {_COLOUR(2)} AS b FROM (SELECT *, (x // 13 * 2 + y // 11) % 5 AS patch, (x * 31 + y * 17 + x * y) % 7 AS noise FROM (SELECT p_partkey % {WIDTH} AS x, p_partkey // {WIDTH} AS y FROM part))),
m AS (SELECT max(x) AS mx, max(y) AS my FROM p), gr AS (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 AS gray FROM p),
bl AS (SELECT *, (gray - (s::BIGINT + 128 >> 8)) ** 2 AS d FROM ({_window(pc.BLUR.tolist(), "gray", "gr", "i.r, i.g, i.b, i.gray")})),
tx AS (SELECT x, y, r, g, b, s::DOUBLE AS tex FROM ({_window(pc.SMOOTH.tolist(), "d", "bl", "i.r, i.g, i.b")})),
sp AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS span, {_FLAT("r")} AS fr, {_FLAT("g")} AS fg, {_FLAT("b")} AS fb FROM tx),
hv AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE (span * round_even(255 * 4096.0 / v, 0)::BIGINT + 2048) >> 12 END AS s,
  CASE WHEN span = 0 THEN 0 ELSE floor((CASE v WHEN r THEN g - b WHEN g THEN b - r + 2 * span ELSE r - g + 4 * span END * round_even(30 * 4096.0 / span, 0) + 2048) / 4096)::BIGINT END AS h0,
  (fr * 0.412453 + fg * 0.357580 + fb * 0.180423) / 0.950456 AS cx, fr * 0.212671 + fg * 0.715160 + fb * 0.072169 AS cy FROM sp),
e AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h, round_even((CASE WHEN cy > 0.008856 THEN cy ** (1.0::DOUBLE / 3) * 116 - 16 ELSE cy * 903.3 END) * 2.55, 0) AS light, round_even(({_ROOT("cx")} - {_ROOT("cy")}) * 500 + 128, 0) AS a,
  (g - r) / (g + r + 1e-6) AS veg, x % 17 = 3 AS cart, x % 17 <> 3 AND y % 23 = 5 AS excl, x % 17 <> 3 AND y % 23 <> 5 AND (x + y) % 6 = 0 AS kgreen, x % 17 <> 3 AND y % 23 <> 5 AND (x + y) % 6 = 1 AS ksand FROM hv)"""
ORACLES = {
    "pixel_texture": f"WITH {_PIXELS} SELECT x, y, round(tex, 6) AS tex, h, s, v, light::BIGINT AS light, a::BIGINT AS a FROM e",
    "pixel_classes": f"""WITH {_PIXELS}, w1 AS (SELECT *, quantile_cont(tex, {pc.QUANTILE}) OVER () AS bound, v < 20 AND tex < 70 AND light < 32 AS w FROM e),
w2 AS (SELECT *, NOT w AND (v > 165 AND veg < 0 AND h >= 8 AND h < 36 AND s > 35 AND r > 150 AND light > 150 OR ksand AND v > 140 AND veg < 0.06) AS sand FROM w1),
w3 AS (SELECT *, NOT w AND NOT sand AND (veg > 0.175 AND h >= 48 AND h <= 85 AND s > 65 AND v > 75 AND v < 190 AND g > r + 20 AND (128 - a) / 128 > 0.04 OR kgreen AND veg > 0.08 AND g > r + 8) AS gre, v > 80 AND v < 205 AND h >= 20 AND h <= 90 AND g + 8 >= r AND NOT w AND NOT sand AS soft FROM w2),
f AS (SELECT x, y, w AND NOT excl AS water, sand AND NOT excl AND NOT cart AS bunker, gre AND NOT excl AS green, gre AND tex < bound AND NOT excl AS tee, soft AND NOT excl AS soft_grass, soft AND NOT gre AND (veg > 0.03 OR h >= 30 AND h <= 75 AND v > 100) AND NOT excl AS fairway FROM w3),
{", ".join(_morphed(name, *k) for name, k in pc.KERNELS.items())}
{" UNION ALL ".join(f"SELECT '{name}' AS class, count(*) AS pixels, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM {name}3 WHERE c HAVING count(*) > 0" for name in pc.KERNELS)}""",
}
