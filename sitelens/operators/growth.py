"""Regions of pixels grown from seeds: spreading through a mask, parts claimed in order, regions of pins, growth along lines.

Work on neighbourhoods goes by tiles that are shipped once with a rim as wide as the work reaches, so a tile's own pixels come out
exact and no group is larger than a tile with its rim, however many pixels a key has. The plane has no border."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.components import components
from sitelens.operators.numbering import number
from sitelens.sources.scratch import materialize

TILE, NONE = 256, np.iinfo(np.int64).max
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
SQUARE = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]


def ellipse(k: int) -> list[tuple[int, int]]:
    """Steps (x, y) of the filled ellipse in a square of k (odd) pixels; of 3 pixels it is a cross."""
    r = k // 2
    return [(i, j) for j in range(-r, r + 1) for i in range(-r, r + 1) if abs(i) <= (round(r * (1 - (j / r) ** 2) ** 0.5) if r else 0)]


def _shifted(a: np.ndarray, i: int, j: int, fill) -> np.ndarray:
    """a moved by (i, j), fill where nothing comes in."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(i) < w and abs(j) < h:
        out[max(j, 0) : h + min(j, 0), max(i, 0) : w + min(i, 0)] = a[max(-j, 0) : h + min(-j, 0), max(-i, 0) : w + min(-i, 0)]
    return out


def dilated(m: np.ndarray, kernel: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([_shifted(m, i, j, False) for i, j in kernel])


def eroded(m: np.ndarray, kernel: list[tuple[int, int]], outside: bool = False) -> np.ndarray:
    return np.logical_and.reduce([_shifted(m, -i, -j, outside) for i, j in kernel])


def _tiles(c: Column, rim: int, tile: int) -> Column:
    return F.explode(F.sequence(F.floor((c - rim) / tile), F.floor((c + rim) / tile)))


def in_tiles(rows: DataFrame, rim: int, tile: int) -> DataFrame:
    """rows(key, x, y, ...) with tx, ty, once for each tile that they lie in or within rim pixels of; rows with a null place or key go."""
    placed = rows.dropna(subset=["key", "x", "y"]).withColumns({c: F.col(c).cast("long") for c in "xy"})
    return placed.withColumn("tx", _tiles(F.col("x"), rim, tile)).withColumn("ty", _tiles(F.col("y"), rim, tile))


def _dense(frame: pd.DataFrame, rim: int, tile: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places of a tile's rows in an array with its rim, and the array's corner."""
    x0, y0 = int(frame["tx"].iloc[0]) * tile - rim, int(frame["ty"].iloc[0]) * tile - rim
    return frame["x"].to_numpy() - x0, frame["y"].to_numpy() - y0, x0, y0


def shaped(pixels: DataFrame, work: list[tuple[str, list[tuple[int, int]]]], tile: int = TILE) -> DataFrame:
    """(key, x, y): pixels(key, x, y) after the steps of work: "grow" or "shrink", each with its kernel. One shuffle for all steps."""
    rim = sum(max(max(abs(i), abs(j)) for i, j in kernel) for _, kernel in work)

    def tile_of(frame: pd.DataFrame) -> pd.DataFrame:
        x, y, x0, y0 = _dense(frame, rim, tile)
        m = np.zeros((tile + 2 * rim,) * 2, bool)
        m[y, x] = True
        for step, kernel in work:
            m = dilated(m, kernel) if step == "grow" else eroded(m, kernel)
        j, i = np.nonzero(m[rim : rim + tile, rim : rim + tile])
        return pd.DataFrame({"key": frame["key"].iloc[0], "x": i + x0 + rim, "y": j + y0 + rim})

    return in_tiles(pixels.select("key", "x", "y"), rim, tile).groupBy("key", "tx", "ty").applyInPandas(tile_of, "key long, x long, y long")


def closed(pixels: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    return shaped(pixels, [("grow", ellipse(k)), ("shrink", ellipse(k))], tile)


def opened(pixels: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    return shaped(pixels, [("shrink", ellipse(k)), ("grow", ellipse(k))], tile)


def spread(mask: DataFrame, seeds: DataFrame, steps: int, wide: bool = False, tile: int = TILE) -> DataFrame:
    """(key, x, y, seed, step): pixels of mask(key, x, y) that seeds(key, x, y, seed long) on it reach within steps through it, over
    8 neighbours where wide, else 4. A pixel belongs to the seed of the fewest steps, ties to the smaller seed.

    Since a way of that many steps stays within as many pixels, one shuffle does for all steps. Tiles that no seed is near to are
    left out before it."""
    near = in_tiles(seeds.select("key", "x", "y"), steps, tile).select("key", "tx", "ty").distinct()
    both = mask.select("key", "x", "y", F.lit(0).cast("long").alias("seed"), F.lit(False).alias("own")).unionByName(
        seeds.where("seed IS NOT NULL").select("key", "x", "y", F.col("seed").cast("long").alias("seed"), F.lit(True).alias("own"))
    )
    rows = in_tiles(both, steps, tile)
    rows = rows.join(near, ["key", "tx", "ty"], "left_semi")
    around = [s for s in (SQUARE if wide else CROSS) if s != (0, 0)]

    def tile_of(frame: pd.DataFrame) -> pd.DataFrame:
        x, y, x0, y0 = _dense(frame, steps, tile)
        is_seed = frame["own"].to_numpy()
        # only the part that holds rows is worked on
        left, top = int(x.min()), int(y.min())
        side = (int(y.max()) - top + 1, int(x.max()) - left + 1)
        m, own = np.zeros(side, bool), np.full(side, NONE)
        m[y[~is_seed] - top, x[~is_seed] - left] = True
        np.minimum.at(own, (y[is_seed] - top, x[is_seed] - left), frame["seed"].to_numpy()[is_seed])
        own[~m] = NONE
        step = np.where(own < NONE, 0, -1)
        for s in range(1, steps + 1):
            front = np.where(step == s - 1, own, NONE)
            come = np.minimum.reduce([_shifted(front, i, j, NONE) for i, j in around])
            new = m & (own == NONE) & (come < NONE)
            if not new.any():
                break
            own[new], step[new] = come[new], s
        j, i = np.nonzero(own < NONE)
        a, b = i + left, j + top
        inner = (a >= steps) & (a < steps + tile) & (b >= steps) & (b < steps + tile)
        i, j, a, b = i[inner], j[inner], a[inner], b[inner]
        return pd.DataFrame({"key": frame["key"].iloc[0], "x": a + x0, "y": b + y0, "seed": own[j, i], "step": step[j, i]})

    return rows.groupBy("key", "tx", "ty").applyInPandas(tile_of, "key long, x long, y long, seed long, step int")


def touching(mask: DataFrame, spine: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, x, y): the parts (8 neighbours) of mask(key, x, y) that hold a pixel of spine(key, x, y).

    Each round spreads by a tile's width, so a part takes as many rounds as it is tiles long."""
    mask = materialize(mask.select("key", "x", "y").distinct(), "mask")
    front, out = spine.select("key", "x", "y"), None
    while True:
        found = materialize(spread(mask, front.withColumn("seed", F.lit(0)), tile, True, tile), "reached")
        out = found.select("key", "x", "y")
        # only pixels at the end of their steps can go on
        if found.where(F.col("step") == tile).isEmpty():
            return out
        front = out


def parts_of(m: np.ndarray) -> list[np.ndarray]:
    """Places (y, x) of each part of 8 neighbours, by the parts' first pixels in rows."""
    left = {(j, i) for j, i in np.argwhere(m).tolist()}
    out = []
    for start in np.argwhere(m).tolist():
        start = tuple(start)
        if start not in left:
            continue
        left.discard(start)
        part, queue = [], deque([start])
        while queue:
            j, i = queue.popleft()
            part.append((j, i))
            for di, dj in SQUARE:
                p = (j + dj, i + di)
                if p in left:
                    left.discard(p)
                    queue.append(p)
        out.append(np.array(part))
    return out


def pick_part(window: np.ndarray, radius: int, least: int) -> np.ndarray | None:
    """Of a window's parts of at least so many pixels the one whose middle lies nearest to the window's, squared distances of one that
    holds the window's middle counted by a twentieth; of equal ones the first in rows."""
    best = None
    for part in parts_of(window):
        if len(part) >= least:
            d = float(((part.sum(0) / len(part) - radius) ** 2).sum()) * (0.05 if (part == radius).all(1).any() else 1.0)
            if best is None or d < best[0]:
                best = d, part
    return None if best is None else best[1]


def claimed_parts(mask: DataFrame, seeds: DataFrame, radius: int, least: int = 8, at_once: int = 256) -> DataFrame:
    """(key, seed, x, y): seeds(key, seed, x, y) in their order each take the part of mask(key, x, y) near them (see pick_part) in the
    square of radius pixels around them, less what earlier seeds took; a seed without one takes nothing.

    Only seeds whose squares can meet depend on each other: they fall into groups by chains of neighbouring cells. A task settles a
    whole group in order, at_once seeds of a larger one at a time (its first ones, which depend on no others)."""
    mask = materialize(mask.select(*[F.col(c).cast("long").alias(c) for c in ("key", "x", "y")]).dropna().distinct(), "mask")
    rest = materialize(seeds.select(*[F.col(c).cast("long").alias(c) for c in ("key", "seed", "x", "y")]).dropna().dropDuplicates(["key", "seed"]), "seeds")
    out, cell = None, 2 * radius + 1
    pull = ["key", "tx", "ty"]
    while True:
        c = rest.select("*", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
        cells = c.select("key", "cx", "cy").distinct().withColumn("id", F.struct("key", "cx", "cy"))
        ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (0, 1), (1, 1), (1, -1))])
        steps = cells.select("key", F.col("id").alias("a"), "cx", "cy", F.explode(ahead).alias("d")).select("key", "a", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
        links = steps.join(cells.withColumnRenamed("id", "b"), ["key", "cx", "cy"]).select("a", "b")
        group = components(cells.select("id"), links).select(F.col("id.key").alias("key"), F.col("id.cx").alias("cx"), F.col("id.cy").alias("cy"), F.col("root").alias("group"))
        grouped = number(c.join(group, ["key", "cx", "cy"]), ["seed"], "_turn", "group")
        grouped = materialize(grouped.select("key", "seed", "x", "y", "group", (F.col("_turn") <= at_once).alias("now")), "grouped")
        now = grouped.where("now").select("key", "seed", "x", "y", "group")
        wide = in_tiles(now, radius, cell).select(*pull, "group", F.col("x").alias("sx"), F.col("y").alias("sy"))
        px = mask.select("*", F.floor(F.col("x") / cell).alias("tx"), F.floor(F.col("y") / cell).alias("ty"))
        near = px.join(wide, pull).where((F.abs(F.col("x") - F.col("sx")) <= radius) & (F.abs(F.col("y") - F.col("sy")) <= radius))
        both = near.select("group", "key", F.lit(0).cast("long").alias("seed"), "x", "y", F.lit(False).alias("own")).distinct().unionByName(now.select("group", "key", "seed", "x", "y", F.lit(True).alias("own")))
        took = materialize(both.groupBy("group").applyInPandas(_claims(radius, least), "key long, seed long, x long, y long"), "claims")
        out = took if out is None else out.unionByName(took)
        rest = grouped.where("NOT now").select("key", "seed", "x", "y")
        if rest.isEmpty():
            return out
        mask = materialize(mask.join(took, ["key", "x", "y"], "left_anti"), "mask")


def _claims(radius: int, least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        px = frame[~frame["own"]].sort_values(["y", "x"])
        x, y, free = px["x"].to_numpy(), px["y"].to_numpy(), np.ones(len(px), bool)
        out = []
        for key, seed, sx, sy in frame[frame["own"]].sort_values("seed")[["key", "seed", "x", "y"]].itertuples(index=False):
            a, b = np.searchsorted(y, [sy - radius, sy + radius + 1])
            at = a + np.nonzero(free[a:b] & (np.abs(x[a:b] - sx) <= radius))[0]
            window = np.zeros((2 * radius + 1,) * 2, bool)
            window[y[at] - sy + radius, x[at] - sx + radius] = True
            part = pick_part(window, radius, least)
            if part is not None:
                window[:] = False
                window[part[:, 0], part[:, 1]] = True
                own = at[window[y[at] - sy + radius, x[at] - sx + radius]]
                free[own] = False
                out.append(pd.DataFrame({"key": key, "seed": seed, "x": x[own], "y": y[own]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", "seed", "x", "y")})

    return settle


def without_holes(m: np.ndarray) -> np.ndarray:
    """m with all that cannot be left over 4 neighbours without crossing it."""
    m = np.pad(m, 1)
    out = np.zeros_like(m)
    out[0, 0] = True
    queue = deque([(0, 0)])
    while queue:
        j, i = queue.popleft()
        for di, dj in CROSS[1:]:
            a, b = j + dj, i + di
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and not out[a, b] and not m[a, b]:
                out[a, b] = True
                queue.append((a, b))
    return ~out[1:-1, 1:-1]


# Greatest colour distance to the pin's surroundings, their half width, vegetation of turf, kernels of the finish.
DELTA, PATCH, TURF, FINISH = 36.0, 3, 0.12, (3, 13)


def pin_region(there: np.ndarray, sure: np.ndarray, loose: np.ndarray, veg: np.ndarray, rgb: np.ndarray, radius: int, snap: int) -> np.ndarray:
    """The region of the pin in the middle of these windows of radius + snap + 20 pixels a side (see pin_regions)."""
    mid = there.shape[0] // 2
    sy = sx = mid
    fit = sure | loose
    if not fit[mid, mid]:
        near = np.s_[mid - snap : mid + snap + 1, mid - snap : mid + snap + 1]
        local = fit[near] if fit[near].any() else there[near] & (veg[near] > TURF)
        if local.any():
            j, i = np.unravel_index(int(np.argmax(np.where(local, veg[near], -np.inf))), local.shape)
            sy, sx = mid - snap + int(j), mid - snap + int(i)
    patch = np.s_[sy - PATCH : sy + PATCH + 1, sx - PATCH : sx + PATCH + 1]
    keep = sure | loose
    if there[patch].any():
        delta = np.sqrt(((rgb - rgb[patch][there[patch]].mean(0)) ** 2).sum(2))
        keep = sure | (loose & (delta <= DELTA))
    yy, xx = np.ogrid[: there.shape[0], : there.shape[1]]
    keep &= there & ((yy - sy) ** 2 + (xx - sx) ** 2 <= radius**2)
    best = None
    for part in parts_of(keep):
        d = int(((part - (sy, sx)) ** 2).sum(1).min())
        if best is None or d < best[0]:
            best = d, part
    m = np.zeros_like(there)
    if best is not None:
        m[best[1][:, 0], best[1][:, 1]] = True
        m = without_holes(m)
        m = dilated(eroded(m, ellipse(FINISH[0])), ellipse(FINISH[0]))
        m = without_holes(eroded(dilated(m, ellipse(FINISH[1])), ellipse(FINISH[1])))
    return m


def pin_regions(pixels: DataFrame, pins: DataFrame, radius: int, snap: int, tile: int = TILE) -> DataFrame:
    """(key, pin, x, y): the turf around each of pins(key, pin, x, y) on pixels(key, x, y, r, g, b, veg, sure, loose).

    A pin off turf first moves within snap pixels to the greenest fit pixel. The region is the part, in the circle of radius around
    it, of sure pixels and of loose ones of its colour that holds it or lies nearest; it is filled, opened and closed. Pins without a
    pixel get no region. Regions may meet; each pin is a group of its own, as large as its window."""
    half = radius + snap + 20
    p = pins.select(*[F.col(c).cast("long").alias(c) for c in ("key", "pin", "x", "y")]).dropna().dropDuplicates(["key", "pin"])
    wide = in_tiles(p, half, tile).select("key", "tx", "ty", "pin", F.col("x").alias("px"), F.col("y").alias("py"))
    colours = [F.col(c).cast("double").alias(c) for c in ("r", "g", "b", "veg")]
    px = pixels.select(F.col("key").cast("long").alias("key"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *colours, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("sure", "loose")]).dropna()
    px = px.select("*", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    near = px.join(wide, ["key", "tx", "ty"]).where((F.abs(F.col("x") - F.col("px")) <= half) & (F.abs(F.col("y") - F.col("py")) <= half)).drop("tx", "ty")

    def region(frame: pd.DataFrame) -> pd.DataFrame:
        px, py = int(frame["px"].iloc[0]), int(frame["py"].iloc[0])
        j, i = frame["y"].to_numpy() - py + half, frame["x"].to_numpy() - px + half
        side = (2 * half + 1,) * 2
        flags = {c: np.zeros(side, bool) for c in ("there", "sure", "loose")}
        flags["there"][j, i] = True
        for c in ("sure", "loose"):
            flags[c][j, i] = frame[c].to_numpy()
        veg, rgb = np.zeros(side), np.zeros((*side, 3))
        veg[j, i], rgb[j, i] = frame["veg"].to_numpy(), frame[["r", "g", "b"]].to_numpy()
        b, a = np.nonzero(pin_region(flags["there"], flags["sure"], flags["loose"], veg, rgb, radius, snap))
        return pd.DataFrame({"key": frame["key"].iloc[0], "pin": frame["pin"].iloc[0], "x": a + px - half, "y": b + py - half})

    return near.groupBy("key", "pin").applyInPandas(region, "key long, pin long, x long, y long")


def near_lines(lines: DataFrame, width: float) -> DataFrame:
    """(key, x, y), distinct: pixels whose middles lie within width of a segment of lines(key, ax, ay, bx, by).

    A segment lists its rows, a row the stretch that its part within width above and below can reach."""
    ends = {c: F.col(c).cast("double") for c in ("ax", "ay", "bx", "by")}
    s = lines.dropna(subset=["ax", "ay", "bx", "by"]).select("key", *[c.alias(n) for n, c in ends.items()])
    s = s.withColumn("y", F.explode(F.sequence(F.ceil(F.least("ay", "by") - width - 0.5), F.floor(F.greatest("ay", "by") + width - 0.5))))
    mid, dx, dy = F.col("y") + 0.5, F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    # a level segment is met by each of its rows from end to end
    at = lambda y, level: F.col("ax") + dx * F.when(dy == 0, F.lit(level)).otherwise(F.least(F.greatest((y - F.col("ay")) / dy, F.lit(0.0)), F.lit(1.0)))
    s = s.withColumns({"_u": at(mid - width, 0.0), "_v": at(mid + width, 1.0)})
    s = s.withColumn("x", F.explode(F.sequence(F.ceil(F.least("_u", "_v") - width - 0.5), F.floor(F.greatest("_u", "_v") + width - 0.5))))
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((F.col("x") + 0.5 - F.col("ax")) * dx + (mid - F.col("ay")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    away = (F.col("x") + 0.5 - F.col("ax") - t * dx) ** 2 + (mid - F.col("ay") - t * dy) ** 2
    return s.where(away <= width * width).select("key", "x", "y").distinct()


def along_lines(lines: DataFrame, sure: DataFrame, soft: DataFrame, search: float, start: float, spine: float, steps: int, tile: int = TILE) -> DataFrame:
    """(key, x, y): turf grown from lines(key, ax, ay, bx, by) over pixels sure(x, y) and soft(x, y) within search of them.

    Soft pixels count only for keys with few sure ones: under 40 or 12 % of the pixels within start of their lines. Growth starts from
    the allowed pixels within start and takes at most steps; keys with under 12 of those keep the allowed parts that touch the pixels
    within spine. Keys with under 12 pixels then get none. What was grown is closed within what is allowed."""
    zone = near_lines(lines, search)
    flags = sure.select("x", "y", F.lit(1).alias("f")).unionByName(soft.select("x", "y", F.lit(0).alias("f"))).groupBy("x", "y").agg(F.max("f").alias("sure"))
    zone = materialize(zone.join(flags, ["x", "y"]).select("key", "x", "y", F.col("sure") == 1), "zone").toDF("key", "x", "y", "sure")
    begin = materialize(near_lines(lines, start), "begin")
    size = begin.groupBy("key").agg(F.count("*").alias("_begin"))
    enough = zone.groupBy("key").agg(F.count(F.when(F.col("sure"), 1)).alias("_sure")).join(size, "key", "left")
    enough = enough.select("key", (F.col("_sure") >= F.greatest(F.lit(40), F.floor(F.coalesce("_begin", F.lit(0)) * 0.12))).alias("_enough"))
    allowed = materialize(zone.join(enough, "key").where("sure OR NOT _enough").select("key", "x", "y"), "allowed")
    first = materialize(begin.join(allowed, ["key", "x", "y"], "left_semi"), "first")
    many = first.groupBy("key").count().where("count >= 12").select("key")
    grown = spread(allowed, first.join(many, "key", "left_semi").withColumn("seed", F.lit(0)), steps, False, tile).select("key", "x", "y")
    thin = materialize(allowed.join(many, "key", "left_anti"), "thin")
    if not thin.isEmpty():
        held = touching(thin, near_lines(lines, spine).join(thin, ["key", "x", "y"], "left_semi"), tile)
        grown = grown.unionByName(held.join(held.groupBy("key").count().where("count >= 12"), "key", "left_semi"))
    return closed(grown, 9, tile).join(allowed, ["key", "x", "y"], "left_semi")
