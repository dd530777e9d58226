import math
import random

from sitelens.operators import filling, refinement

M = 1 / 111_320.0  # a metre, in degrees
SHAPE = "array<struct<x:double,y:double>>"
MAPPED, FOUND = f"site long, layer string, feat long, shape {SHAPE}, source string", f"site long, layer string, found long, shape {SHAPE}, agreed boolean"
OUTLINES, PINS, GREENS = f"site long, outline long, lon double, lat double, shape {SHAPE}", "site long, pin long, lon double, lat double", f"site long, feat long, shape {SHAPE}"
HOLES = f"site long, hole long, number long, line {SHAPE}"
GROUND = f"site long, shape {SHAPE}"


def _ring(*points):
    return [{"x": x * M, "y": y * M} for x, y in points]


def _box(x0, y0, x1, y1):
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _disc(x, y, r, n=24):
    return _ring(*((x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)))


def _inside(ring, x, y):
    held = False
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
            held = not held
    return held


def test_overlaps_equal_counts_of_cells(spark):
    """Concave shapes of whole metres: shared ground is the number of unit cells in both."""
    rng = random.Random(5)

    def ell(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h // 2), (x + w // 2, y + h // 2), (x + w // 2, y + h), (x, y + h)]

    def units(ring):
        return [{"x": x * 1e-5, "y": y * 1e-5} for x, y in ring]

    a, b = ([(i, ell(rng.randrange(-40, 40), rng.randrange(-40, 40), rng.randrange(4, 30), rng.randrange(4, 30))) for i in range(25)] for _ in "ab")
    make = lambda rows: spark.createDataFrame([(1, i, units(r)) for i, r in rows] + [(1, 99, None), (1, 98, []), (None, 97, units(rows[0][1]))], f"site long, id long, shape {SHAPE}")
    got = {(r.a, r.b): round(r.both / 1e4) for r in refinement.overlaps(make(a), make(b), ["site"]).collect()}
    want = {}
    for i, p in a:
        for j, q in b:
            n = sum(_inside(p, x + 0.5, y + 0.5) and _inside(q, x + 0.5, y + 0.5) for x in range(-40, 70) for y in range(-40, 70))
            if n:
                want[i, j] = n
    assert got == want


def test_pegged_each_decision(spark):
    mapped = [(1, "bunker", 1, _box(0, 0, 20, 20), None), (1, "bunker", 2, _box(10, 0, 30, 20), "survey"), (1, "green", 3, _box(0, 0, 20, 20), None), (1, "bunker", 4, None, None), (None, "bunker", 5, _box(0, 0, 9, 9), None)]
    found = [
        (1, "bunker", 11, _box(0, 0, 20, 20), False),  # all of 1, half of 2
        (1, "bunker", 12, _box(10, 0, 22, 20), True),  # 2 takes it, being left
        (1, "bunker", 13, _box(28, 0, 38, 20), True),  # a fifth on 2
        (1, "bunker", 14, _box(29, 0, 49, 20), True),  # a twentieth on 2: added
        (1, "bunker", 15, _box(100, 0, 120, 20), None),
        (1, "green", 16, _box(100, 0, 120, 20), True),
        (2, "bunker", 17, _box(0, 0, 20, 20), True),  # another site
        (1, "bunker", 18, _box(5, 5, 6, 6), True),  # too little of 1, but covered by it
        (1, "bunker", 19, _box(0, 0, 20, 20), True),  # as good as 11, later
        (1, None, 20, _box(0, 0, 20, 20), True),
    ]
    got = refinement.pegged(spark.createDataFrame(mapped, MAPPED), spark.createDataFrame(found, FOUND)).collect()
    assert {r.feat: r.source for r in got if r.decision == "kept"} == {1: "openstreetmap", 2: "survey", 3: "openstreetmap", 4: "openstreetmap", 5: "openstreetmap"}
    of = {r.found: (r.decision, r.feat) for r in got if r.found is not None}
    # 2 is half covered by 11, 12 and 19, of which 12 covers more
    assert of == {11: ("matched", 1), 12: ("matched", 2), 13: ("overlap", None), 14: ("added", None), 15: ("single", None), 16: ("layer", None), 17: ("added", None), 18: ("overlap", None), 19: ("overlap", None), 20: ("layer", None)}
    none = refinement.pegged(spark.createDataFrame([], MAPPED), spark.createDataFrame([], FOUND))
    assert none.count() == 0


def test_preferred_and_trees_equal_plain_passes(spark):
    rng = random.Random(9)
    point = lambda: (rng.randrange(0, 60) * M, rng.randrange(0, 60) * M)
    a, b = ([(s, i, *point()) for i in range(40) for s in (i % 2,)] for _ in "ab")
    df = lambda rows: spark.createDataFrame([*rows, (1, 900, None, 0.0)], "site long, outline long, lon double, lat double")
    got = {(r.outline, r.replaces, r.origin) for r in refinement.preferred(df(a), df([(s, 100 + i, x, y) for s, i, x, y in b])).collect()}
    used, want = {}, set()
    for s, i, x, y in a:
        near = [((x - u) ** 2 + (y - v) ** 2, 100 + j) for t, j, u, v in b if t == s and 100 + j not in used and math.hypot(x - u, y - v) / M < 14 - 1e-9]
        if near:
            used[min(near)[1]] = i
        else:
            want.add((i, None, "mosaic"))
    want |= {(100 + j, used.get(100 + j), "crop") for _, j, _, _ in b} | {(900, None, "crop"), (900, None, "mosaic")}
    assert got == want

    trees = lambda rows: spark.createDataFrame([*rows, (1, 901, None, 0.0)], "site long, tree long, lon double, lat double")
    kept = {r.tree for r in refinement.merged_trees(trees(a[:6]), trees(b)).collect()}
    close = lambda p, q: p[0] == q[0] and math.hypot(p[2] - q[2], p[3] - q[3]) / M < 8 - 1e-9
    held = []
    for t in b:
        if not any(close(t, o) for o in a[:6]) and not any(close(t, o) for o in held):
            held.append(t)
    assert kept == {t[1] for t in held}


def test_greens_are_refined_moved_or_left(spark):
    greens = [(1, 1, _disc(0, 0, 14)), (1, 2, _disc(200, 0, 12)), (1, 3, _disc(400, 0, 14)), (1, 4, _disc(600, 0, 14)), (1, 5, _disc(800, 0, 14)), (1, 6, _disc(1000, 0, 12)), (1, 7, None)]
    pins = [(1, 1, 0.0, 0.0), (1, 2, 202 * M, 0.0), (1, 3, 398 * M, 0.0), (1, 4, 402 * M, 0.0), (1, 5, 600 * M, 0.0), (1, 6, 1000 * M, 0.0), (1, 9, 500.0, 0.0)]
    outlines = [
        (1, 1, 1 * M, 0.0, _disc(2, 1, 13)),  # tighter: taken
        (1, 2, 202 * M, 0.0, _disc(205, 2, 18)),  # larger: the green moves
        (1, 3, 398 * M, 0.0, _disc(400, 0, 12)),  # two pins in the green
        (1, 4, 600 * M, 0.0, _ring((600, -1), (700, -1), (700, 1), (600, 1))),  # a sausage
        (1, 6, 1000 * M, 0.0, _disc(1020, 0, 21)),  # larger and too far
        (1, 7, 1000 * M, 0.0, None),
    ]
    got = {r.feat: r for r in refinement.refined_greens(spark.createDataFrame(greens, GREENS), spark.createDataFrame(outlines, OUTLINES), spark.createDataFrame(pins, PINS)).collect()}
    assert {k: r.decision for k, r in got.items()} == {1: "refined", 2: "moved", 3: "shared", 4: "gate", 5: "none", 6: "gate", 7: "none"}
    assert abs(got[1].refined_m2 / (math.pi * 13**2) - 1) < 0.03
    # moved by (5, 2) metres, hardly clipped: the size stays
    assert abs(got[2].refined_m2 / got[2].mapped_m2 - 1) < 0.03
    xs, ys = ([p[c] / M for p in got[2].shape] for c in "xy")
    assert abs((min(xs) + max(xs)) / 2 - 205) < 0.3 and abs((min(ys) + max(ys)) / 2 - 2) < 0.3
    assert len(got[4].shape) == 24 and got[7].shape is None


def test_missing_greens(spark):
    holes = [(1, 1, 1, None, 0.0, 0.0), (1, 2, 1, None, 100 * M, 0.0), (1, 3, 3, None, 200 * M, 0.0), (1, 4, 4, 77, 0.0, 0.0), (1, 5, 5, None, None, None), (1, 6, 6, None, 300 * M, 0.0)]
    outlines = [(1, i, x * M, 0.0, s) for i, x, s in ((1, 2, _disc(0, 0, 12)), (2, 100, _disc(100, 0, 12)), (3, 200, _disc(200, 0, 12)), (4, 301, _disc(322, 0, 12)), (5, 0, None))]
    greens = [(1, _disc(215, 0, 12)), (2, _disc(0, 0, 12))]
    df = spark.createDataFrame
    got = filling.filled_greens(df(holes, "site long, hole long, number long, green long, lon double, lat double"), df(outlines, OUTLINES), df(greens, GROUND))
    # 2: hole 1 has the number already; 3: on another green; 6: its outline does not reach the pin
    assert {r.hole: (r.decision, r.outline) for r in got.collect()} == {1: ("filled", 1), 2: ("skipped", None), 3: ("skipped", None), 5: ("skipped", None), 6: ("skipped", None)}


def test_gap_by_dense_points(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        ring = [(x, y), (x + 30, y), (x + 30, y + 10), (x + 12, y + 10), (x + 12, y + 40), (x, y + 40)]
        rows.append((i, ring, [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(rng.randrange(1, 4))]))
    df = spark.createDataFrame([(i, _ring(*r), _ring(*q)) for i, r, q in rows], f"i long, r {SHAPE}, q {SHAPE}")
    got = {r.i: r.d for r in df.select("i", filling.gap(F.col("r"), F.col("q")).alias("d")).collect()}
    for i, ring, line in rows:
        dense = [(a[0] + (b[0] - a[0]) * k / 400, a[1] + (b[1] - a[1]) * k / 400) for a, b in zip(line, line[1:] or line, strict=False) for k in range(401)]
        rim = [(a[0] + (b[0] - a[0]) * k / 100, a[1] + (b[1] - a[1]) * k / 100) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) for k in range(100)]
        near = 0.0 if any(_inside(ring, *p) for p in dense) else min(math.hypot(p[0] - s[0], p[1] - s[1]) for p in dense for s in rim)
        assert abs(got[i] - near) < 0.4


def test_fairways_and_corridors(spark):
    """The corridor of a bent line, on grass, without a green, within a boundary: its area against counted points."""
    line = [(0, 0), (150, 0), (220, 120)]
    holes = [(1, 10, 1, _ring(*line)), (1, 11, 2, _ring((0, 500), (200, 500))), (1, 12, 3, _ring((0, 900), (200, 900))), (1, 13, 3, _ring((0, 1200), (200, 1200))), (2, 20, 1, _ring((0, 0), (90, 0))), (2, 21, 2, None)]
    fairways = [
        (1, 1, _box(50, 525, 90, 560), None),  # 25 m from hole 2's line
        (1, 2, _box(50, 700, 90, 740), 7),  # far from all, no hole 7
        (1, 3, _box(50, 700, 90, 740), None),
        (2, 4, _box(900, 0, 940, 40), None),
        (2, 5, None, 2),  # by its own number
    ]
    grass, spare, bounds = [(1, _box(-30, -60, 400, 15))], [(1, _box(100, -10, 130, 12))], [(1, _box(-10, -300, 3000, 3000))]
    df = spark.createDataFrame
    got = filling.derived_fairways(df(fairways, f"site long, feat long, shape {SHAPE}, hole long"), df(holes, HOLES), df(grass, GROUND), df(spare, GROUND), df(bounds, GROUND)).collect()
    assert {r.feat: r.number for r in got if r.feat} == {1: 2, 2: 7, 3: None, 4: None, 5: 2}
    drawn = {(r.site, r.number): r for r in got if not r.feat}
    assert sorted(drawn) == [(1, 1), (1, 3), (2, 1)]

    def away(p):
        out = []
        for a, b in zip(line, line[1:], strict=False):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy), 0), 1)
            out.append(math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1]))
        return min(out)

    def held(p):
        return away(p) <= filling.HALF and -10 <= p[0] and -60 <= p[1] <= 15 and not (100 <= p[0] <= 130 and -10 <= p[1] <= 12)

    points = [(x + 0.5, y + 0.5) for x in range(-40, 280) for y in range(-40, 160)]
    shape, inner = ([[(p.x / M, p.y / M) for p in r] for r in rings] for rings in ([drawn[1, 1].shape], drawn[1, 1].holes))
    found = sum(_inside(shape[0], *p) and not any(_inside(h, *p) for h in inner) for p in points)
    want = sum(held(p) for p in points)
    assert len(inner) == 1 and abs(found / want - 1) < 0.01
    # hole 3's line has no grass near: the whole corridor, cut by the boundary, of the first hole of that number
    assert abs(min(p.x for p in drawn[1, 3].shape) / M + 10) < 0.1 and max(p.y for p in drawn[1, 3].shape) / M < 930
