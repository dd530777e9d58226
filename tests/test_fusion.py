import math
import random

from sitelens.operators import fusion

FEATS = "site long, layer string, feat long, shape array<struct<x:double,y:double>>, area boolean, hole int, source string"
POINTS = "site long, point long, kind string, hole int, lon double, lat double"
CARDS = "site long, pars array<int>, indexes array<int>"
M = 1 / 111_320.0  # a metre, in degrees


def _square(x, y, half=5):
    return [{"x": (x + i * half) * M, "y": (y + j * half) * M} for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def _line(*points):
    return [{"x": x * M, "y": y * M} for x, y in points]


def _point(site, point, kind, hole, x, y):
    return (site, point, kind, hole, x * M, y * M)


FEATURES = [
    (1, "pin", 10, _line((0, 0)), False, None, None),
    (1, "green", 11, _square(0, 0), True, None, None),  # holds the pin of hole 1
    (1, "green", 12, _square(60, 0), True, None, None),  # 42 m from hole 2's pin
    (1, "green", 13, _square(500, 500), True, 7, None),  # far, but numbered
    (1, "green", 14, _square(900, 500), True, None, None),  # far: goes
    (1, "green", 15, None, True, None, None),
    (1, "tee", 20, _square(0, 300), True, None, "survey"),
    (1, "tee", 21, _square(5, 300), True, 3, None),
    (1, "tee", 22, _square(4000, 300), True, None, None),
    (1, "hole_centerline", 30, _line((0, 1), (0, 300)), False, None, None),
    (1, "bunker", 40, _square(3, 3), True, None, None),
    (2, "pin", 50, _line((0, 0)), False, 4, None),
    (2, "pin", 51, [], False, 4, None),
    (2, "green", 52, _square(0, 0), True, None, None),
    (2, "tee", 53, _square(0, 0), True, None, None),
    (2, "hole_centerline", 54, _line((0, 0), (5, 5)), False, None, None),
]
GIVEN = [
    _point(1, 1, "green", 1, 80, 80),  # hole 1 has a pin too
    _point(1, 2, "pin", 1, 1, 1),
    _point(1, 3, "pin", 2, 97, 0),
    _point(1, 4, "tee", 1, 1, 300),  # takes 20, the first in reach
    _point(1, 5, "tee", 1, 1, 320),  # takes 21
    _point(1, 6, "tee", 2, 1, 310),  # nothing is left
    _point(1, 7, "dogleg", 1, 30, 100),
    _point(1, 8, "dogleg", 1, 30, 200),
    (1, 9, "pin", 3, 400.0, 0.0),
    _point(2, 60, "bunker", None, 0, 0),
]


def test_layers_are_fused(spark):
    feats, points, cards = spark.createDataFrame(FEATURES, FEATS), spark.createDataFrame(GIVEN, POINTS), spark.createDataFrame([(1, [4], [9, 3]), (1, [4], [9, 3])], CARDS)
    got = fusion.fused(feats, points, cards).collect()
    of = lambda site, layer: {(r.feat, r.point): r for r in got if r.site == site and r.layer == layer}
    assert len(got) == len({(r.site, r.layer, r.feat, r.point, r.hole) for r in got})
    assert {k: v.hole for k, v in of(1, "pin").items()} == {(None, 2): 1, (None, 3): 2}
    assert {k[0]: (v.hole, v.given_hole) for k, v in of(1, "green").items()} == {11: (1, 1), 12: (2, 2), 13: (7, None)}
    tees = of(1, "tee")
    assert {k: (v.hole, v.given_hole, v.source, v.geom_source) for k, v in tees.items()} == {(20, 4): (1, 1, "catalog", "survey"), (21, 5): (1, 1, "catalog", "openstreetmap"), (None, 6): (2, None, "catalog", None)}
    added = tees[None, 6].shape
    assert len(added) > 32 and all(abs(math.hypot(p.x / M - 1, p.y / M - 310) - 7) < 0.05 for p in added)
    lines = {r.hole: r for r in of(1, "hole_centerline").values()} | {r.hole: r for r in got if r.site == 1 and r.layer == "hole_centerline"}
    assert [(round(p.x / M), round(p.y / M)) for p in lines[1].shape] == [(1, 320), (30, 200), (30, 100), (1, 1)]
    assert [(round(p.x / M), round(p.y / M)) for p in lines[2].shape] == [(1, 310), (97, 0)]
    assert {h: (r.par, r.stroke_index, r.feat) for h, r in lines.items()} == {1: (4, 9, None), 2: (None, 3, None)}
    assert list(of(1, "bunker")) == [(40, None)]
    # a site whose points are no pins, tees or bends keeps its layers
    assert {(r.layer, r.feat) for r in got if r.site == 2} == {("pin", 50), ("green", 52), ("tee", 53), ("hole_centerline", 54)}


def test_pins_without_numbers(spark):
    points = spark.createDataFrame([_point(1, 1, "pin", None, 0, 0), _point(1, 2, "green", 0, 5, 0), _point(2, 3, "pin", None, 0, 0), _point(2, 4, "green", 5, 0, 0)], POINTS)
    got = sorted((p.site, tuple(p.turn), p.point, p.hole) for p in fusion.chosen_pins(points).collect())
    assert got == [(1, (0, 2), 2, None), (1, (1, 1), 1, None), (2, (5, 0), 4, 5)]


def test_lines_take_holes_in_turn(spark):
    r = random.Random(8)
    at = lambda: (r.randint(0, 1000), r.randint(0, 1000))
    pins = {(s, h): at() for s in (1, 2) for h in range(1, 7)}
    lines = {(s, 100 * s + i): (at(), at(), at()) for s in (1, 2, 3) for i in range(10)}
    feats = spark.createDataFrame([(s, "hole_centerline", f, _line(*p), False, None, None) for (s, f), p in lines.items()] + [(1, "hole_centerline", 1, _line((0, 0)), False, 5, None)], FEATS)
    points = spark.createDataFrame([_point(s, 10 * s + h, "pin", h, *p) for (s, h), p in pins.items()], POINTS)
    want, used = {}, set()
    for (s, f), p in sorted(lines.items()):
        near = sorted((min(math.dist(p[0], q), math.dist(p[2], q)), h) for (t, h), q in pins.items() if t == s)
        free = [h for _, h in near if (s, h) not in used]
        want[f] = (free or [h for _, h in near] or [None])[0]
        used.add((s, want[f]))
    got = {x.feat: x for x in fusion.fused_lines(feats, points, spark.createDataFrame([(1, [3, 4, 5], None)], CARDS), "catalog").collect()}
    assert {f: x.hole for f, x in got.items() if f != 1} == want
    assert (got[1].hole, got[1].given_hole) == (5, None)
    assert all(got[f].par == {1: 3, 2: 4, 3: 5}.get(h) for f, h in want.items() if f < 200) and all(got[f].par is None for f in want if f >= 200)


def test_what_counts_as_the_site(spark):
    points = spark.createDataFrame([_point(1, i, "tee", None, x, y) for i, (x, y) in enumerate([(0, 0), (1000, 0), (1000, 1000), (0, 1000), (500, 500)])] + [_point(2, 9, "pin", 1, 0, 0), (3, 10, "pin", 1, 400.0, 0.0)], POINTS)
    bounds = spark.createDataFrame([(s, _square(0, 0)) for s in (1, 3)] + [(4, []), (5, None)], "site long, ring array<struct<x:double,y:double>>")
    got = {c.site: c for c in fusion.clips(points, bounds).collect()}
    assert {s: c.origin for s, c in got.items()} == {1: "given", 2: "given", 3: "mapped"}
    area = lambda ring: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 / M / M
    assert abs(area(got[1].ring) / (1e6 + 4 * 130_000 + math.pi * 130**2) - 1) < 0.005
    assert abs(area(got[2].ring) / (math.pi * 130**2) - 1) < 0.01


def test_nothing_to_fuse(spark):
    none = spark.createDataFrame([], FEATS), spark.createDataFrame([], POINTS), spark.createDataFrame([], CARDS)
    assert fusion.fused(*none).count() == 0
    feats = spark.createDataFrame(FEATURES, FEATS)
    assert fusion.fused(feats, none[1], none[2]).where("layer <> 'pin'").count() == len([f for f in FEATURES if f[1] != "pin"])
