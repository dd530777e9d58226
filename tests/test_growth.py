import random

import numpy as np
import pytest

from sitelens.operators import growth

PIXELS = "key long, x long, y long"
SEEDS = "key long, seed long, x long, y long"


def _mask(seed, keys=(1, 2), side=40, share=0.6):
    r = random.Random(seed)
    return sorted({(k, x, y) for k in keys for x in range(-side // 2, side // 2) for y in range(side) if r.random() < share})


@pytest.mark.parametrize("tile, steps, wide", [(8, 5, False), (16, 20, True), (256, 9, False)])
def test_seeds_spread_as_by_a_plain_search(spark, tile, steps, wide):
    mask = _mask(tile)
    r = random.Random(steps)
    seeds = [(k, 2**60 + i, x, y) for i, (k, x, y) in enumerate(r.sample(mask, 12))] + [(1, 5, 900, 900), (1, None, 0, 0), (None, 6, 0, 0)]
    seeds.append((seeds[0][0], 7, *seeds[0][2:]))  # two seeds at one place: the smaller one
    got = growth.spread(spark.createDataFrame(mask + [(1, None, 3), (None, 0, 0), mask[0]], PIXELS), spark.createDataFrame(seeds, SEEDS), steps, wide, tile)
    want, front, held = {}, {}, set(mask)
    for k, s, x, y in seeds:
        if s is not None and (k, x, y) in held:
            front[k, x, y] = min(s, front.get((k, x, y), s))
    for step in range(steps + 1):
        want |= {p: (s, step) for p, s in front.items()}
        ahead = {}
        for (k, x, y), s in front.items():
            for i, j in growth.SQUARE if wide else growth.CROSS:
                p = (k, x + i, y + j)
                if p in held and p not in want:
                    ahead[p] = min(s, ahead.get(p, s))
        front = ahead
    assert {(p.key, p.x, p.y): (p.seed, p.step) for p in got.collect()} == want


def test_nothing_spreads_from_nothing(spark):
    none = spark.createDataFrame([], PIXELS)
    assert growth.spread(none, spark.createDataFrame([], SEEDS), 3).count() == growth.touching(none, none).count() == growth.closed(none, 5).count() == 0
    assert growth.claimed_parts(none, spark.createDataFrame([(1, 1, 0, 0)], SEEDS), 3).count() == 0


def _plain_parts(cells):
    left, out = set(cells), []
    for start in sorted(cells, key=lambda p: (p[1], p[0])):
        if start in left:
            part, queue = {start}, [start]
            left.discard(start)
            while queue:
                x, y = queue.pop()
                for i, j in growth.SQUARE:
                    if (x + i, y + j) in left:
                        left.discard((x + i, y + j))
                        part.add((x + i, y + j))
                        queue.append((x + i, y + j))
            out.append(part)
    return out


def test_parts_that_touch_a_spine(spark):
    mask = _mask(5, share=0.3)
    spine = random.Random(1).sample(mask, 10)
    want = {(k, *p) for k in (1, 2) for part in _plain_parts([(x, y) for q, x, y in mask if q == k]) if any((k, *p) in spine for p in part) for p in part}
    for tile in (4, 64):
        got = growth.touching(spark.createDataFrame(mask, PIXELS), spark.createDataFrame(spine, PIXELS), tile).collect()
        assert sorted((p.key, p.x, p.y) for p in got) == sorted(want)


@pytest.mark.parametrize("at_once", [2, 256])
def test_parts_are_claimed_in_turn(spark, at_once):
    radius, mask = 6, _mask(9, share=0.45)
    r = random.Random(4)
    seeds = [(k, i, r.randint(-20, 20), r.randint(0, 40)) for i in range(14) for k in (1, 2)] + [(1, 99, 10_000, 0)]
    free, want = set(mask), set()
    for k, s, sx, sy in sorted(seeds):
        window = [(x, y) for q, x, y in free if q == k and abs(x - sx) <= radius and abs(y - sy) <= radius]
        scored = []
        for n, part in enumerate(_plain_parts(window)):
            mx, my = (sum(p[c] for p in part) / len(part) for c in (0, 1))
            d = ((mx - sx) ** 2 + (my - sy) ** 2) * (0.05 if (sx, sy) in part else 1)
            if len(part) >= 8:
                scored.append((round(d, 9), n, part))
        if scored:
            part = min(scored, key=lambda c: c[:2])[2]
            want |= {(k, s, *p) for p in part}
            free -= {(k, *p) for p in part}
    got = growth.claimed_parts(spark.createDataFrame(mask, PIXELS), spark.createDataFrame(seeds + seeds[:3], SEEDS), radius, at_once=at_once).collect()
    assert {(p.key, p.seed, p.x, p.y) for p in got} == want and len(got) == len(want)


def test_closing_and_opening_as_sets(spark):
    mask = _mask(11, keys=(1,), share=0.5)
    cells = {(x, y) for _, x, y in mask}
    grow = lambda s, k: {(x + i, y + j) for x, y in s for i, j in growth.ellipse(k)}
    shrink = lambda s, k: {(x - i, y - j) for x, y in s for i, j in growth.ellipse(k) if all((x - i + a, y - j + b) in s for a, b in growth.ellipse(k))}
    df = spark.createDataFrame(mask, PIXELS)
    for tile in (8, 256):
        assert {(p.x, p.y) for p in growth.closed(df, 7, tile).collect()} == shrink(grow(cells, 7), 7) >= cells
        assert {(p.x, p.y) for p in growth.opened(df, 3, tile).collect()} == grow(shrink(cells, 3), 3) <= cells
    assert len(growth.ellipse(3)) == 5 and len(growth.ellipse(5)) == 17 and growth.ellipse(1) == [(0, 0)]


def test_a_pin_finds_its_green(spark):
    """A disc of one colour in a field of another, with a hole; pins in it, beside it, and far from any pixel."""
    inside = lambda x, y: (x - 50) ** 2 + (y - 40) ** 2 <= 100 and (x, y) != (52, 40)
    px = [(1, x, y, *((60, 160, 60, 0.45, True, True) if inside(x, y) else (130, 150, 90, 0.07, False, True))) for x in range(100) for y in range(80)]
    df = spark.createDataFrame(px, "key long, x long, y long, r int, g int, b int, veg double, sure boolean, loose boolean")
    pins = spark.createDataFrame([(1, 1, 50, 40), (1, 2, 52, 40), (1, 3, 500, 500), (2, 4, 50, 40), (1, None, 50, 40)], "key long, pin long, x long, y long")
    disc = growth.dilated(growth.eroded(np.array([[(x - 50) ** 2 + (y - 40) ** 2 <= 100 for x in range(100)] for y in range(80)]), growth.ellipse(3)), growth.ellipse(3))
    disc = growth.eroded(growth.dilated(disc, growth.ellipse(13)), growth.ellipse(13))
    want = {(x, y) for y, x in np.argwhere(disc).tolist()}
    for tile in (16, 256):
        got = growth.pin_regions(df, pins, 30, 4, tile).collect()
        assert {p.pin for p in got} == {1, 2}
        assert {(p.x, p.y) for p in got if p.pin == 1} == want
        # loose pixels of the pin's own colour belong to it, those of the disc are sure
        assert {(p.x, p.y) for p in got if p.pin == 2} >= want
    # turf of another colour is left out though it is loose, that within the colours' distance is not
    near = df.withColumn("r", df.r - 60).where("NOT sure OR x > 0")
    assert len([p for p in growth.pin_regions(near, pins.where("pin = 1"), 30, 4).collect()]) >= len(want)


def test_pixels_near_lines(spark):
    r = random.Random(2)
    lines = [(i % 5, *(r.uniform(-30, 30) for _ in range(4))) for i in range(20)] + [(7, 3, 4, 3, 4), (8, 0, 2, 20, 2), (9, 5, -3, 5, 12), (9, None, 0, 1, 1)]
    got = growth.near_lines(spark.createDataFrame([tuple(v if i == 0 or v is None else float(v) for i, v in enumerate(row)) for row in lines], "key long, ax double, ay double, bx double, by double"), 3.5).collect()
    want = set()
    for k, ax, ay, bx, by in lines:
        if ax is None:
            continue
        for x in range(-36, 36):
            for y in range(-36, 36):
                dx, dy = bx - ax, by - ay
                t = min(max(((x + 0.5 - ax) * dx + (y + 0.5 - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
                if (x + 0.5 - ax - t * dx) ** 2 + (y + 0.5 - ay - t * dy) ** 2 <= 3.5**2:
                    want.add((k, x, y))
    assert {(p.key, p.x, p.y) for p in got} == want and len(got) == len(want)
