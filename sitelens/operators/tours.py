"""Numbers of holes drafted from tees and greens: pairs by cost, then a tour from green to nearest green."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators import matching

#: Fixed value: what a pair's length is multiplied by when its line meets a fairway, divided by the number it meets.
ON_FAIRWAY = 0.35


def meets_box(ax: Column, ay: Column, bx: Column, by: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether a segment has a point in a box: the stretches of it between the box's sides, both ways, have one in common."""
    dx, dy = bx - ax, by - ay

    def stretch(a: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        safe = F.when(d != 0, d)
        t, u = (low - a) / safe, (high - a) / safe
        inside = (a >= low) & (a <= high)
        return F.when(d != 0, F.least(t, u)).when(inside, 0.0).otherwise(2.0), F.when(d != 0, F.greatest(t, u)).when(inside, 1.0).otherwise(-1.0)

    (t0, t1), (u0, u1) = stretch(ax, dx, w, e), stretch(ay, dy, s, n)
    return F.greatest(t0, u0, F.lit(0.0)) <= F.least(t1, u1, F.lit(1.0))


def pairs(tees: DataFrame, greens: DataFrame, fairways: DataFrame) -> DataFrame:
    """(site, tee, green): greedy pairs of a site's tees(site, tee, lon, lat) and greens(site, green, rlon, rlat) by the length between them;
    a line that meets k boxes of fairways(site, fairway, w, s, e, n) costs ON_FAIRWAY / k of it."""
    both = tees.join(greens, "site")
    met = both.join(fairways, "site").where(meets_box(*[F.col(c) for c in ("lon", "lat", "rlon", "rlat", "w", "s", "e", "n")])).groupBy("tee", "green").agg(F.count("*").alias("hits"))
    cost = F.hypot(F.col("lon") - F.col("rlon"), F.col("lat") - F.col("rlat")) * F.coalesce(F.lit(ON_FAIRWAY) / F.col("hits"), F.lit(1.0))
    costed = both.join(met, ["tee", "green"], "left").select("site", "tee", "green", F.round(cost, 12).alias("cost"))
    return matching.greedy_pairs(costed, "tee", "green", "cost").select("site", "tee", "green")


def nearest_order(points: list[tuple[float, float]], start: tuple[float, float]) -> list[int]:
    """The order of a tour that goes from the start to the nearest point, from there to the nearest left, and so on; ties to the earlier point.

    Points lie in the cells of a grid, from which they are taken as they are visited; cells around the last point are looked into
    ring by ring. The grid is made anew whenever half of its points are gone, so cells stay neither crowded nor empty."""
    left = dict(enumerate(points))
    order: list[int] = []
    x, y = start
    while left:
        xs, ys = [p[0] for p in left.values()], [p[1] for p in left.values()]
        west, south, east, north = min(xs), min(ys), max(xs), max(ys)
        size = max(math.sqrt(max((east - west) * (north - south), 0.0) / len(left)), (east - west) / len(left), (north - south) / len(left)) or 1.0
        cells: dict[tuple[int, int], set[int]] = {}
        for k, (px, py) in left.items():
            cells.setdefault((int((px - west) // size), int((py - south) // size)), set()).add(k)
        wide, high = int((east - west) // size), int((north - south) // size)
        for _ in range((len(left) + 1) // 2):
            cx, cy = math.floor((x - west) / size), math.floor((y - south) / size)
            best: tuple[float, int] | None = None
            # rings that lie outside the grid altogether are passed over
            r = max(0, -cx, cx - wide, -cy, cy - high)
            while True:
                ring = [(i, j) for i in range(max(cx - r, 0), min(cx + r, wide) + 1) for j in ((cy - r, cy + r) if abs(i - cx) < r else range(max(cy - r, 0), min(cy + r, high) + 1))]
                for cell in ring:
                    for k in cells.get(cell, ()):
                        d = ((left[k][0] - x) ** 2 + (left[k][1] - y) ** 2, k)
                        best = d if best is None or d < best else best
                if best is not None and math.sqrt(best[0]) < r * size or r > max(abs(cx), abs(cx - wide), abs(cy), abs(cy - high)):
                    break
                r += 1
            k = best[1]
            order.append(k)
            x, y = left.pop(k)
            cells[int((x - west) // size), int((y - south) // size)].discard(k)
    return order


def tours(greens: DataFrame, origins: DataFrame) -> DataFrame:
    """(site, green, number): a site's greens(site, green, rlon, rlat) numbered along the tour from its origin (site, ox, oy).

    Each step waits for the one before it, so a site's greens are one task's; of a site only they are gathered."""
    rows = greens.join(origins, "site").select("site", "green", "rlon", "rlat", "ox", "oy")

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(held: list[tuple]) -> pd.DataFrame:
            order = nearest_order([(r[2], r[3]) for r in held], (held[0][4], held[0][5]))
            return pd.DataFrame({"site": [held[k][0] for k in order], "green": [held[k][1] for k in order], "number": range(1, len(order) + 1)})

        held: list[tuple] = []
        for frame in frames:
            for r in frame.itertuples(index=False, name=None):
                if held and r[0] != held[0][0]:
                    yield number(held)
                    held = []
                held.append(r)
        if held:
            yield number(held)

    return rows.repartition("site").sortWithinPartitions("site", "green").mapInPandas(along, "site long, green long, number long")


def drafted(tees: DataFrame, greens: DataFrame, fairways: DataFrame, origins: DataFrame) -> DataFrame:
    """(site, number, green, tee): a hole for each green, with its tee where one was paired."""
    return tours(greens, origins).join(pairs(tees, greens, fairways), ["site", "green"], "left").select("site", "number", "green", "tee")
