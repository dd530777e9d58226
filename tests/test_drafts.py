"""Drafts, shapes and payloads against plain Python."""

import math
import random

from pyspark.sql import functions as F

from sitelens.functions import metric, payloads, rings
from sitelens.operators import drafts, shapes


def test_free_numbers(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, None, r.randrange(1, 28)])) for i in range(300)]
    df = spark.createDataFrame(rows, "site string, feat long, ref int").repartition(5)
    want = {}
    for site in ("a", "b", None):
        used, turn = {x[2] for x in rows if x[0] == site and x[2]}, 0
        for _, i, ref in (x for x in rows if x[0] == site):
            if ref:
                want[i] = ref
                continue
            turn += 1
            while turn in used:
                turn += 1
            want[i] = turn
    assert {x.feat: x.number for x in drafts.draft_numbers(df, "site", "feat", "ref").collect()} == want
    assert drafts.draft_numbers(df.where("feat < 0"), "site", "feat", "ref").count() == 0


def test_nearest_however_far(spark):
    r = random.Random(6)
    left = [(i, i % 3, r.uniform(0, 40), r.uniform(0, 40)) for i in range(60)]
    right = [(i, i % 2, *r.choice([(r.uniform(0, 1), r.uniform(0, 1)), (30.0, 30.0)])) for i in range(40)]
    got = drafts.nearest_any(spark.createDataFrame(left, "id long, site long, lon double, lat double"), spark.createDataFrame(right, "pin long, site long, rlon double, rlat double"), "id", "pin", ["site"], 0.01)
    want = {i: min(((x - u) ** 2 + (y - v) ** 2, j) for j, t, u, v in right if t == s)[1] for i, s, x, y in left if s < 2}
    assert {x.id: x.pin for x in got.collect()} == want


def test_hulls(spark):
    r = random.Random(7)
    rows = [(k, float(r.randrange(12)), float(r.randrange(12))) for k in range(1, 9) for _ in range(k * k)] + [(0, 1.0, 1.0)] * 3 + [(9, None, 1.0), (10, 0.0, 0.0), (10, 1.0, 1.0), (10, 2.0, 2.0)]
    got = {x.key: [(p.x, p.y) for p in x.ring] for x in shapes.hulls(spark.createDataFrame(rows, "key long, x double, y double").repartition(6)).collect()}
    assert set(got) == {*range(9), 10} and got[0] == [(1.0, 1.0)] and got[10] == [(0.0, 0.0), (2.0, 2.0)]
    for key, ring in got.items():
        held = {(x, y) for k, x, y in rows if k == key}
        assert set(ring) <= held
        if len(ring) > 2:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in held)
                assert all((bx - ax) * (y - ay) != (by - ay) * (x - ax) or min(ax, bx) <= x <= max(ax, bx) for x, y in held)


def test_rings_of_relations(spark):
    """Ways in any order and direction, an open ring, a lone point, an empty table."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(1, i, "outer", ([square[i], square[(i + 1) % 4]])[:: 1 if i % 2 else -1]) for i in (2, 0, 3, 1)]
    rows += [(1, 9, "inner", [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]), (1, 5, None, [(9.0, 9.0)]), (2, 0, "", [(0.0, 0.0), (1.0, 0.0)])]
    df = spark.createDataFrame(rows, "relation long, place long, role string, points array<struct<x:double,y:double>>")
    got = {(x.relation, x.role): (x.n, x.a) for x in shapes.relation_rings(df).select("relation", "role", F.size("ring").alias("n"), rings.area(F.col("ring")).alias("a")).collect()}
    assert got == {(1, "outer"): (4, 16.0), (1, "inner"): (3, 0.5)}
    assert shapes.relation_rings(df.where("relation < 0")).count() == 0


def test_areas_on_the_ellipsoid(spark):
    """The whole ellipsoid, a circle of the web map by its ground width, points in and out of a ring."""
    c = F.lit
    one = spark.range(1)
    half = rings.box(c(-90.0), c(-90.0), c(90.0), c(90.0))
    x = one.select(metric.ellipsoid_area(half).alias("half"), metric.ellipsoid_area(metric.capsule(c(10.0), c(60.0), c(10.0), c(60.0), 100.0)).alias("circle"), rings.contains(half, c(0.0), c(0.0)).alias("inside"), rings.contains(half, c(91.0), c(0.0)).alias("out")).first()
    assert abs(x.half * 2 / 510.0656e12 - 1) < 1e-6
    # 64 chords; metres of the web map are half as long on the ground at 60 degrees
    assert abs(x.circle / (32 * math.sin(math.pi / 32) * 100**2 / 4) - 1) < 0.01
    assert x.inside and not x.out


def test_points_of_payloads(spark):
    rows = [
        (1, '[{"lat": 1.5, "lon": "2", "hole": 20, "poi": "1", "location": 2}, {"latitude": 1.5000001, "lng": 2, "no": 2, "type": "flag"}, 5, null]'),
        (2, '{"pois": [{"lat": "x", "lon": 1}, {"lat": 1, "lon": 1, "hole": 0}]}'),
        (3, "no json"),
        (4, None),
        (5, '{"other": [1]}'),
    ]
    got = payloads.points(spark.createDataFrame(rows, "id long, p string"), "id", "p", F.lit(18)).collect()
    assert sorted((x.id, x.place, x.hole or 0, x.kind, x.lat, x.lon) for x in got) == [(1, 0, 2, "pin", 1.5, 2.0), (2, 1, 0, "poi", 1.0, 1.0)]
