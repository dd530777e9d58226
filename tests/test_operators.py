"""Operators against plain Python."""

import random

from pyspark.sql import functions as F

from sitelens.functions import rings
from sitelens.operators import components, matching, spatial
from sitelens.operators.numbering import number


def test_numbers_follow_the_order(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, "a", "b", "c"]), r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, kind string, v double").repartition(7)
    got = {x.id: x.place for x in number(df, [F.desc("v"), "id"], "place").collect()}
    assert got == {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda x: (-x[2], x[0])), 1)}
    got = {x.id: x.place for x in number(df, ["v"], "place", "kind").collect()}
    want = {}
    for kind in (None, "a", "b", "c"):
        want |= {i: k for k, (i, _, _) in enumerate(sorted((x for x in rows if x[1] == kind), key=lambda x: x[2]), 1)}
    assert got == want and number(df.where("id < 0"), ["v"], "place").count() == 0


def test_kept_apart_and_first_unused(spark):
    r = random.Random(2)
    pairs = {(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(150)) if a != b}
    kept = []
    for i in range(60):
        if not any((i, k) in pairs or (k, i) in pairs for k in kept):
            kept.append(i)
    nodes = spark.range(60)
    got = matching.kept_apart(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert sorted(x.id for x in got.collect()) == kept
    used, want = set(), {}
    for i in range(60):
        for j in sorted(b for a, b in pairs if a == i):
            if j not in used:
                used.add(j)
                want[i] = j
                break
    got = matching.first_unused(spark.createDataFrame(sorted(pairs), "l long, r long"), "l", "r")
    assert {x.l: x.r for x in got.collect()} == want


def test_pixels(spark):
    r = random.Random(3)
    held = {(r.randrange(30), r.randrange(30)) for _ in range(420)}
    p = spark.createDataFrame([(x * 100 + y, x, y) for x, y in sorted(held)], "id long, x long, y long")
    for wide in (False, True):
        near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (wide or 0 in (i, j))]
        root, left = {}, set(held)
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                for i, j in near:
                    if (x + i, y + j) in left:
                        left.remove((x + i, y + j))
                        todo.append((x + i, y + j))
            root |= {x * 100 + y: min(a * 100 + b for a, b in part) for x, y in part}
        assert {x.id: x.root for x in components.components(p, components.links(p, wide)).collect()} == root
    square = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    grown = {(x + i, y + j) for x, y in held for i, j in square}
    worn = {(x, y) for x, y in held if all((x + i, y + j) in held for i, j in square)}
    assert {tuple(x) for x in components.dilate(p, 3).select("x", "y").collect()} == grown
    assert {tuple(x) for x in components.erode(p, 3).select("x", "y").collect()} == worn


def test_near_pairs(spark):
    r = random.Random(4)
    a = [(i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(200)]
    got = spatial.near(spark.createDataFrame(a, "a long, lon double, lat double"), spark.createDataFrame(a, "b long, rlon double, rlat double"), 0.1)
    want = {(i, j) for i, x, y in a for j, u, v in a if (x - u) ** 2 + (y - v) ** 2 <= 0.1 * 0.1}
    found = [(x.a, x.b) for x in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_clipped_areas(spark):
    """A triangle within a square; rings that do not meet, that hold each other, without extent."""
    point = lambda ps: [(float(x), float(y)) for x, y in ps]
    square = point([(0, 0), (4, 0), (4, 4), (0, 4)])
    cases = [
        (point([(-2, 0), (2, 0), (2, 4)]), 6.0),
        (point([(8, 8), (9, 8), (9, 9)]), 0.0),
        (point([(1, 1), (2, 1), (2, 2), (1, 2)]), 1.0),
        (point([(-9, -9), (9, -9), (9, 9), (-9, 9)]), 16.0),
        (point([(1, 1), (2, 2)]), 0.0),
    ]
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(a, square, w) for a, w in cases], f"a {ring}, b {ring}, want double")
    for x in df.select("want", rings.overlap(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(x.want - x.got) < 1e-9
