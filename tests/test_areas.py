import math
import random

import pytest

from sitelens.operators import areas, overlay, raster

SCHEMA = "key long, ring array<struct<x:bigint,y:bigint>>, hole boolean"
BOX = [(0, 0), (100, 0), (100, 100), (0, 100)]


def _area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _frame(spark, rows):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r], h) for k, r, h in rows], SCHEMA)


def _rings(df):
    return sorted((x.key, [(p.x, p.y) for p in x.ring]) for x in df.collect())


def test_a_square_grows_and_shrinks(spark):
    grown = [r for _, r in _rings(areas.buffered(_frame(spark, [(1, [(1000 * x, 1000 * y) for x, y in BOX], None)]), 10_000))]
    assert len(grown) == 1 and abs(_area(grown[0]) - (100_000**2 + 400_000 * 10_000 + 32 * math.sin(math.pi / 32) * 10_000**2)) < 1e-4 * 100_000**2
    assert _rings(areas.buffered(_frame(spark, [(1, BOX, None)]), -10)) == [(1, [(10, 10), (90, 10), (90, 90), (10, 90)])]
    assert _rings(areas.buffered(_frame(spark, [(1, BOX, None)]), -60)) == []


def test_a_hole_shrinks_as_its_shape_grows(spark):
    hole = [(40, 40), (60, 40), (60, 60), (40, 60)]
    rings = [r for _, r in _rings(areas.buffered(_frame(spark, [(1, BOX, False), (1, hole, True)]), 5))]
    assert sorted(round(_area(r)) for r in rings)[0] == -100
    assert len(_rings(areas.buffered(_frame(spark, [(1, BOX, False), (1, hole, True)]), 10))) == 1


def test_crossed_rings_are_repaired(spark):
    rows = [(1, [(0, 0), (100, 100), (100, 0), (0, 100)], None), (2, BOX, None), (3, [(0, 0), (10, 0), (5, 1)], None), (4, [(0, 0), (50, 0), (50, 2), (100, 0), (100, 100), (0, 100)], None), (5, BOX[::-1], None)]
    got = _rings(areas.repaired(_frame(spark, rows), least=6.0, deviation=3.0))
    assert [(k, abs(_area(r))) for k, r in got] == [(1, 2500), (1, 2500), (2, 10_000), (4, 10_000), (5, 10_000)]


def test_corners_stay_where_they_deviate():
    r = random.Random(3)
    line = [(10 * i, r.randint(-1, 1)) for i in range(50)]
    ring = [*line, (490, 400), (0, 400)]
    out = areas.keep_corners(ring, 4)
    assert len(out) < 10 and {(490, 400), (0, 400)} <= set(out)
    for x, y in line:  # what goes lies near what stays
        ends = sorted(p for p in out if p[1] < 10)
        a, b = next((a, b) for a, b in zip(ends, ends[1:]) if a[0] <= x <= b[0])
        assert abs((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])) / math.dist(a, b) <= 4
    assert areas.keep_corners(ring, 0) == [p for p in ring if p in areas.keep_corners(ring, 0)]


def test_holes_find_their_outer_rings(spark):
    rows = [(1, [(0, 0), (1000, 0), (1000, 1000), (0, 1000)], False)]
    for k in range(1, 9):  # eight holes in a row, an island in each
        x = 100 * k
        rows += [(1, [(x, 400), (x + 80, 400), (x + 80, 480), (x, 480)], True), (1, [(x + 20, 420), (x + 60, 420), (x + 60, 460), (x + 20, 460)], False), (1, [(x + 30, 430), (x + 40, 430), (x + 40, 440), (x + 30, 440)], True)]
    rows += [(2, BOX, False)]
    for tile in (64, 1 << 17):
        got = sorted((s.key, len(s.outer), s.outer[0].x, sorted(h[0].x for h in s.holes)) for s in areas.nested(areas.dissolve(_frame(spark, rows), tile), tile).collect())
        assert got == [(1, 4, 0, [100 * k for k in range(1, 9)]), *((1, 4, 100 * k + 20, [100 * k + 30]) for k in range(1, 9)), (2, 4, 0, [])]


def test_plane_and_back(spark):
    df = spark.createDataFrame([(1, [{"x": -9.5, "y": 38.0}, {"x": 12.25, "y": -61.0}])], "key long, ring array<struct<x:double,y:double>>")
    there = df.select(areas.mercator(df.ring).alias("m"))
    back = there.select(areas.lonlat(there.m).alias("r")).first().r
    assert all(abs(p.x - x) < 1e-7 and abs(p.y - y) < 1e-7 for p, (x, y) in zip(back, [(-9.5, 38.0), (12.25, -61.0)], strict=True))


@pytest.mark.parametrize("cell", [4, 256])
def test_rings_of_masks_paint_the_masks_again(spark, cell):
    r = random.Random(cell)
    cells = sorted({(k, r.randint(0, 14), r.randint(0, 14)) for k in (1, 2) for _ in range(120)})
    rings = raster.mask_rings(spark.createDataFrame(cells, "key long, x long, y long"), cell)
    back = raster.pixels_of(rings.select("key", overlay.unsnapped(rings.ring, 1.0).alias("ring")))
    assert sorted((p.key, p.x, p.y) for p in back.collect()) == cells
    assert all(a[0] == b[0] or a[1] == b[1] for _, q in _rings(rings) for a, b in zip(q, q[1:] + q[:1]))


def test_the_last_painted_stays(spark):
    shapes = [(1, 10, 0, BOX), (1, 11, 2, [(50, 50), (150, 50), (150, 150), (50, 150)]), (1, 12, 1, [(60, 0), (70, 0), (70, 200), (60, 200)])]
    df = spark.createDataFrame([(k, s, t, [{"x": x, "y": y} for x, y in r]) for k, s, t, r in shapes], "key long, shape long, turn int, ring array<struct<x:bigint,y:bigint>>")
    got = {(p.x, p.y): p.turn for p in raster.painted(df).collect()}
    assert got[0, 0] == 0 and got[55, 55] == got[65, 65] == 2 and got[65, 10] == got[65, 199] == 1 and (110, 10) not in got
    assert len(got) == 10_000 + 10_000 - 2500 + 10 * 50
