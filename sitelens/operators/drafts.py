"""Drafts of holes: numbers, ways round, greens; the nearest right row however far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import metric
from sitelens.operators import matching, spatial
from sitelens.operators.numbering import number
from sitelens.sources.scratch import materialize


def draft_numbers(holes: DataFrame, site: str, order: str, ref: str) -> DataFrame:
    """holes with a number: their ref where they have one (two holes of one ref both keep it), else, in their order, the next
    number of the site that no ref takes.

    Only a site's distinct refs (few, since refs are small numbers) are gathered; the i-th free number follows from them in
    closed form, so no row waits for the one before it."""
    used = holes.where(F.col(ref).isNotNull()).groupBy(F.col(site).alias("_site")).agg(F.array_sort(F.collect_set(ref)).alias("_used"))
    placed = number(holes.where(F.col(ref).isNull()), [order], "_i", site).join(used, F.col(site).eqNullSafe(F.col("_site")), "left")
    i = F.col("_i")
    # the k-th used number (from 0) lies before the i-th free one if used - k <= i
    before = F.coalesce(F.size(F.filter("_used", lambda r, k: r - k <= i)), F.lit(0))
    cols = holes.columns
    free = placed.select(*cols, (i + F.when(F.col("_used").isNull(), 0).otherwise(before)).cast("long").alias("number"))
    return holes.where(F.col(ref).isNotNull()).select(*cols, F.col(ref).cast("long").alias("number")).unionByName(free)


def nearest_any(left: DataFrame, right: DataFrame, key: str, rid: str, keys: list[str], start: float, max_rounds: int = 40) -> DataFrame:
    """(key, rid, d2): each left(key, lon, lat, keys) row's nearest right(rid, rlon, rlat, keys) row of equal keys, ties to the
    smaller rid; lefts without one are dropped.

    The reach doubles round by round, and a left row leaves as soon as it has a right row within the reach, so the pairs formed are
    near ones only, however many rows a key has."""
    right = materialize(right, "right")
    rest = materialize(left.join(right.select(*keys).distinct(), keys, "left_semi"), "rest")
    out, reach = None, start
    for _ in range(max_rounds):
        found = spatial.near(rest, right, reach, keys).groupBy(key).agg(F.min(F.struct("d2", rid)).alias("b"))
        found = materialize(found.select(key, f"b.{rid}", "b.d2"), "nearest")
        out = found if out is None else out.unionByName(found)
        rest = materialize(rest.join(found, key, "left_anti"), "rest")
        if rest.isEmpty():
            return out
        reach *= 2
    raise RuntimeError(f"nearest_any: rows are left after {max_rounds} rounds")


def turned(lines: DataFrame, pins: DataFrame, tees: DataFrame, catch: float, clear: float = 6.0, start: float = 0.02) -> DataFrame:
    """(line, turned): whether a line (line, site, ax, ay, bx, by) runs from its green to its tee and must be reversed.

    An end nearer to a pin of the site by more than clear metres is the green; else the end with more tees within catch metres is
    the start. Nearest pins are first looked for within start degrees."""
    ends = lines.select("line", "site", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}x").alias("lon"), F.col(f"{e}y").alias("lat")) for e in "ab"])).alias("e"))
    ends = materialize(ends.select(F.concat_ws(":", "line", "e.end").alias("key"), "line", "site", "e.end", "e.lon", "e.lat"), "ends")
    pin = nearest_any(ends.select("key", "site", "lon", "lat"), pins, "key", "pin", ["site"], start).select("key", (F.sqrt("d2") * metric.METRES).alias("away"))
    near = spatial.near(ends.select("key", "site", "lon", "lat"), tees, catch / metric.METRES, ["site"])
    tee = near.where(F.sqrt("d2") * metric.METRES < catch).groupBy("key").agg(F.count("*").alias("tees"))
    both = ends.select("key", "line", "end").join(pin, "key", "left").join(tee, "key", "left")
    at = lambda end, c, none: F.coalesce(F.max(F.when(F.col("end") == end, F.col(c))), F.lit(none))
    w = both.groupBy("line").agg(*[at(e, c, n).alias(f"{c}_{e}") for e in "ab" for c, n in (("away", 1e9), ("tees", 0))])
    by_pin = F.when(F.col("away_a") + clear < F.col("away_b"), True).when(F.col("away_b") + clear < F.col("away_a"), False)
    return w.select("line", by_pin.otherwise(F.col("tees_b") > F.col("tees_a")).alias("turned"))


def to_square(x: Column, y: Column, cx: Column, cy: Column, half: float) -> Column:
    """Squared distance of a point to a square, 0 within it."""
    dx, dy = (F.greatest(F.abs(a - b) - half, F.lit(0.0)) for a, b in ((x, cx), (y, cy)))
    return dx * dx + dy * dy


def two_phase_greens(holes: DataFrame, greens: DataFrame, half: float, touch: float, reach: float) -> DataFrame:
    """(hole, green, phase): greens (green, site, rlon, rlat: squares of half degrees) given to holes (hole, site, ex, ey: their
    end, px, py: their pin or NULL), each used once.

    First holes whose pin lies in a green or within touch metres of it, by the distance to its centre; then holes without a green, by
    the distance of their end to a green within reach metres. Ties: smaller hole, then smaller green."""
    span = lambda metres: (half + metres / metric.METRES) * 1.5
    d2 = lambda metres: (metres / metric.METRES) ** 2
    pins = holes.where("px IS NOT NULL").select("hole", "site", F.col("px").alias("lon"), F.col("py").alias("lat"))
    rim = to_square(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat"), half)
    claims = spatial.near(pins, greens, span(touch), ["site"]).where((rim < d2(touch))).select("hole", "green", "d2")
    first = materialize(matching.greedy_pairs(claims, "hole", "green", "d2").select("hole", "green", F.lit(1).alias("phase")), "first")
    rest = holes.join(first, "hole", "left_anti").select("hole", "site", F.col("ex").alias("lon"), F.col("ey").alias("lat"))
    left = spatial.near(rest, greens.join(first, "green", "left_anti"), span(reach), ["site"]).select("hole", "green", rim.alias("d2")).where(F.col("d2") <= d2(reach))
    second = matching.greedy_pairs(left, "hole", "green", "d2").select("hole", "green", F.lit(2).alias("phase"))
    return first.unionByName(second)


def first_of_keys(rows: DataFrame, keys: tuple[str, str], order: str) -> DataFrame:
    """Pairs of keys, with their first row's order, that a pass in the order keeps: one goes if an earlier kept one has either key."""
    once = rows.groupBy(*keys).agg(F.min(order).alias(order))
    return matching.greedy_pairs(once, *keys, order)
