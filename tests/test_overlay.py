import random

import numpy as np
import pytest

from sitelens.operators import overlay, tracing

SCHEMA = "key long, side int, ring array<struct<x:bigint,y:bigint>>"


def _area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _winding(rings, x, y):
    """Plain ray casting of a point off all edges."""
    n = 0
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            if (y0 <= y) != (y1 <= y) and (x1 - x0) * (y - y0) / (y1 - y0) + x0 > x:
                n += 1 if y1 > y0 else -1
    return n


def _star(r, cx, cy, size, n):
    """A concave ring around a centre, anticlockwise."""
    turns = np.sort([r.random() for _ in range(n)]) * 2 * np.pi
    return [(int(cx + size * q * np.cos(t)), int(cy + size * q * np.sin(t))) for t, q in zip(turns, [r.uniform(0.3, 1) for _ in range(n)])]


def _shapes(seed, keys=3, each=6, span=4000):
    r = random.Random(seed)
    out = []
    for key in range(keys):
        for _ in range(each):
            cx, cy, size = r.randint(-span, span), r.randint(-span, span), r.randint(300, 1800)
            side = r.randint(0, 1)
            out.append((key, side, _star(r, cx, cy, size, r.randint(3, 14))))
            if r.random() < 0.5:  # a hole around the same centre
                out.append((key, side, _star(r, cx, cy, size * 0.2, 6)[::-1]))
    out.append((9, 0, [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]))  # neighbours that share a side, and a corner
    out.append((9, 1, [(1000, 0), (2000, 0), (2000, 1000), (1000, 1000)]))
    out.append((9, 0, [(2000, 1000), (3000, 1000), (3000, 2000), (2000, 2000)]))
    return out


RULES = {
    "union": lambda a, b: a != 0 or b != 0,
    "intersection": lambda a, b: a != 0 and b != 0,
    "difference": lambda a, b: a != 0 and b == 0,
    "parity": lambda a, b: (a + b) % 2 == 1,
}


def _frame(spark, shapes):
    return spark.createDataFrame([(k, s, [{"x": x, "y": y} for x, y in r]) for k, s, r in shapes], SCHEMA)


@pytest.mark.parametrize("operation,tile,crowded,at_once", [*((op, 1024, 24, 10) for op in RULES), ("difference", 1 << 17, 400, 100_000)])
def test_overlay_matches_ray_casting(spark, operation, tile, crowded, at_once):
    shapes = _shapes(len(operation))
    got = {}
    for x in overlay.overlay(_frame(spark, shapes), operation, tile, crowded, at_once).collect():
        got.setdefault(x.key, []).append([(p.x, p.y) for p in x.ring])
    r = random.Random(1)
    wrong = n = 0
    for key in {k for k, *_ in shapes}:
        sides = [[ring for k, s, ring in shapes if k == key and s == side] for side in (0, 1)]
        for _ in range(400):
            x, y = r.randint(-5500, 5500) + 0.37, r.randint(-5500, 5500) + 0.41
            want = RULES[operation](_winding(sides[0], x, y), _winding(sides[1], x, y))
            found = _winding(got.get(key, []), x, y)
            assert found in (0, 1)
            n += 1
            wrong += found != want
    # rounding moves an edge by less than a unit, so points next to one may differ
    assert wrong <= 0.004 * n


def test_union_of_neighbours_is_one_ring(spark):
    squares = [(1, 0, [(x, y), (x + 100, y), (x + 100, y + 100), (x, y + 100)]) for x in range(0, 1000, 100) for y in range(0, 1000, 100) if not (300 <= x < 600 and 300 <= y < 500)]
    for tile in (64, 1 << 17):
        got = [[(p.x, p.y) for p in x.ring] for x in overlay.overlay(_frame(spark, squares), "union", tile, at_once=50).collect()]
        assert sorted(got) == [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)], [(300, 300), (300, 500), (600, 500), (600, 300)]]


def test_odd_input(spark):
    rows = [(1, 0, None), (None, 0, [{"x": 0, "y": 0}]), (1, 0, [{"x": 0, "y": 0}, {"x": 5, "y": 5}]), (1, 0, [None, {"x": None, "y": 1}]), (2, 0, [{"x": 0, "y": 0}] * 4)]
    for operation in RULES:
        assert overlay.overlay(spark.createDataFrame(rows, SCHEMA), operation).count() == 0
        assert overlay.overlay(spark.createDataFrame([], SCHEMA), operation).count() == 0
    bow = _frame(spark, [(1, 0, [(0, 0), (10, 10), (10, 0), (0, 10)])] * 1)
    assert sorted(_area([(p.x, p.y) for p in x.ring]) for x in overlay.overlay(bow, "parity").collect()) == [25, 25]


def test_tiles_cover_a_ring():
    r = random.Random(4)
    for _ in range(50):
        ring = _star(r, 0, 0, 3000, 12)
        parts = list(overlay.tiled(ring, 512))
        assert all(tx * 512 <= x <= tx * 512 + 512 and ty * 512 <= y <= ty * 512 + 512 for tx, ty, part in parts for x, y in part)
        assert abs(sum(_area(p) for *_, p in parts) - _area(ring)) < 4000 * 12


def test_cycles_are_ranked(spark):
    r = random.Random(6)
    cycles = [r.sample(range(k * 10_000, k * 10_000 + 9000), n) for k, n in enumerate([1, 2, 3, 17, 500])]
    nodes = [(a, b) for c in cycles for a, b in zip(c, c[1:] + c[:1])]
    got = {x.id: (x.first, x.steps) for x in tracing.rank_cycles(spark.createDataFrame(nodes, "id long, next long")).collect()}
    assert got == {a: (min(c), (c.index(min(c)) - i) % len(c)) for c in cycles for i, a in enumerate(c)}
