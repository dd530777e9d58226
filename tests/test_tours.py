import math
import random

import pytest

from sitelens.functions import rings
from sitelens.operators import shapes, tours


@pytest.mark.parametrize("n", [1, 2, 3, 40, 700])
def test_tours_visit_the_nearest_left(n):
    r = random.Random(n)
    points = [(r.gauss(0, 1), r.gauss(0, 5)) for _ in range(n)] + ([(50.0, 50.0)] * 3 if n > 2 else [])
    left, want, at = list(range(len(points))), [], (9.0, -3.0)
    while left:
        k = min(left, key=lambda k: ((points[k][0] - at[0]) ** 2 + (points[k][1] - at[1]) ** 2, k))
        left.remove(k)
        want.append(k)
        at = points[k]
    assert tours.nearest_order(points, (9.0, -3.0)) == want


def test_long_tours_end():
    r = random.Random(1)
    order = tours.nearest_order([(r.random(), r.random() ** 6) for _ in range(40_000)], (0.0, 0.0))
    assert sorted(order) == list(range(40_000))


def test_lines_along_fairways_come_first(spark):
    tees = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 11, 0.0, 9.0)], "site long, tee long, lon double, lat double")
    greens = spark.createDataFrame([(1, 20, 5.0, 0.0), (1, 21, 8.0, 9.0), (1, 22, 90.0, 90.0), (2, 23, 0.0, 0.0)], "site long, green long, rlon double, rlat double")
    fairways = spark.createDataFrame([(1, 30, 3.0, 8.0, 4.0, 10.0)], "site long, fairway long, w double, s double, e double, n double")
    origins = spark.createDataFrame([(1, 8.0, 8.0), (2, 0.0, 0.0)], "site long, ox double, oy double")
    got = sorted((x.site, x.number, x.green, x.tee) for x in tours.drafted(tees, greens, fairways, origins).collect())
    assert got == [(1, 1, 21, 11), (1, 2, 20, 10), (1, 3, 22, None), (2, 1, 23, None)]


def test_rings_of_many_ways(spark):
    r = random.Random(3)
    n = 3000
    corners = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    lines = [[corners[k], corners[(k + 1) % n]][:: r.choice([1, -1])] for k in range(n)]
    r.shuffle(lines)
    lines += [[(5.0, 5.0), (6.0, 5.0)], [(6.0, 6.0), (6.0, 5.0)]]  # an open one
    got = shapes._joined(lines)
    assert sorted(map(len, got)) == [3, n]
    assert shapes._joined([[(0.0, 0.0), (1.0, 0.0)]]) == []


def test_elongation_is_that_of_the_smallest_rectangle(spark):
    r = random.Random(8)
    sets = {k: [(r.gauss(0, 3), r.gauss(0, 1)) for _ in range(12)] for k in range(10)} | {99: [(0.0, 0.0), (4.0, 4.0), (5.0, 3.0), (1.0, -1.0)]}
    df = spark.createDataFrame([(k, x, y) for k, ps in sets.items() for x, y in ps], "key long, x double, y double")
    got = {h.key: h.e for h in shapes.hulls(df).select("key", rings.elongation(shapes.F.col("ring")).alias("e")).collect()}

    def brute(ps):
        found = []
        for step in range(180_00):  # turn by turn
            t = math.pi * step / 180_00
            u, v = [x * math.cos(t) + y * math.sin(t) for x, y in ps], [y * math.cos(t) - x * math.sin(t) for x, y in ps]
            a, b = max(u) - min(u), max(v) - min(v)
            found.append((a * b, max(a, b) / min(a, b)))
        return min(found)[1]

    assert all(abs(got[k] - brute(ps)) < 0.02 * got[k] for k, ps in sets.items()) and abs(got[99] - 4) < 1e-9
