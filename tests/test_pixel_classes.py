import colorsys
import random

import numpy as np
from pyspark.sql import functions as F

from sitelens.operators import growth
from sitelens.operators import pixel_classes as pc

PIXELS = "key long, x long, y long, r int, g int, b int"


def _image(seed, width, height, key=1):
    r = random.Random(seed)
    return [(key, x - 3, y + 5, *(r.randint(0, 255) for _ in "rgb")) for x in range(width) for y in range(height)]


def _smooth(a, weights):
    rim = len(weights) // 2
    a = np.pad(a, rim, mode="reflect")
    a = sum(w * a[k : a.shape[0] - 2 * rim + k] for k, w in enumerate(weights))
    return sum(w * a[:, k : a.shape[1] - 2 * rim + k] for k, w in enumerate(weights))


def test_texture_is_the_same_over_tiles(spark):
    rows = _image(1, 23, 19) + _image(2, 9, 30, 2)
    df = spark.createDataFrame(rows + [rows[0], (1, None, 2, 1, 1, 1), (1, 0, 7, None, 1, 1)], PIXELS)
    want = {}
    for key in (1, 2):
        own = [p for p in rows if p[0] == key]
        a = np.zeros((max(p[2] for p in own) - 4, max(p[1] for p in own) + 4), np.int64)
        for _, x, y, r, g, b in own:
            a[y - 5, x + 3] = (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14
        t = _smooth((a - ((_smooth(a, pc.BLUR) + 128) >> 8)).astype(float) ** 2, pc.SMOOTH)
        want |= {(key, x, y): t[y - 5, x + 3] for _, x, y, *_ in own}
    for tile in (8, 256):
        assert {(p.key, p.x, p.y): p.tex for p in pc.textured(df, tile).collect()} == want


def test_hues_are_near_exact_ones(spark):
    """Half a step, and what the whole-number factors add."""
    df = spark.createDataFrame(_image(3, 20, 20), PIXELS)
    h, s, v = pc.hsv(df.r, df.g, df.b)
    for p in df.select("r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v")).collect():
        a, b, c = colorsys.rgb_to_hsv(p.r / 255, p.g / 255, p.b / 255)
        assert min(abs(p.h - a * 180), 180 - abs(p.h - a * 180)) <= 0.55 and abs(p.s - b * 255) <= 0.55 and p.v == round(c * 255)
    light, a = pc.lab(*[F.lit(c) for c in (255, 255, 255)])
    green = pc.lab(*[F.lit(c) for c in (0, 255, 0)])[1]
    assert df.select(light, a, green).first()[:] == (255, 128, 42)


def test_quantiles_lie_between_values(spark):
    r = random.Random(6)
    rows = [(k, r.choice([0.5, 1.25, r.random()])) for k, n in ((1, 1), (2, 2), (3, 401)) for _ in range(n)]
    got = dict(tuple(x) for x in pc.quantiles(spark.createDataFrame(rows, "key long, tex double"), "tex", 0.55).collect())
    assert {k: round(v, 12) for k, v in got.items()} == {k: round(float(np.percentile([v for q, v in rows if q == k], 55)), 12) for k in (1, 2, 3)}


def test_classes_hold_to_what_is_known(spark):
    """A field of turf too dull for a green; within it a place known as green, and a boundary around half of it."""
    px = spark.createDataFrame([(k, x, y, 88, 108, 60) for k in (1, 2) for x in range(40) for y in range(40)], PIXELS)
    known = [(1, x, y, "green") for x in range(5, 20) for y in range(5, 20)] + [(1, x, y, "boundary") for x in range(25) for y in range(40)] + [(2, x, y, "exclude") for x in range(10) for y in range(40)]
    got = {tile: pc.classes(px, spark.createDataFrame(known, "key long, x long, y long, kind string"), tile).collect() for tile in (16, 256)}
    assert sorted(map(tuple, got[16])) == sorted(map(tuple, got[256])) and len(got[16]) == 3200
    green = {(p.x, p.y) for p in got[256] if p.key == 1 and p.green}
    square = {(x, y) for x in range(5, 20) for y in range(5, 20)}
    assert green <= square and len(square - green) <= 8  # a cross rounds corners
    assert {(p.x, p.y) for p in got[256] if p.key == 1 and p.soft_grass} == {(x, y) for x in range(25) for y in range(40)}
    assert {(p.x, p.y) for p in got[256] if p.key == 2 and p.fairway} == {(x, y) for x in range(10, 40) for y in range(40)}
    assert not any(p.water or p.bunker or (p.green and p.key == 2) for p in got[256])


def test_images_without_pixels(spark):
    assert pc.classes(spark.createDataFrame([], PIXELS)).count() == 0
    assert growth.ellipse(9)[0] == (0, -4)
