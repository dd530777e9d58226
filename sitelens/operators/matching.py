"""Assignment joins: greedy one-to-one, nearest within reach, segments that cross."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators import spatial
from sitelens.operators.components import components
from sitelens.operators.numbering import number
from sitelens.sources.scratch import materialize


#: Rounds of mutual firsts before connected groups are settled whole, and the pairs of a group that one task settles at a time.
ROUNDS, AT_ONCE = 4, 100_000


def greedy_pairs(pairs: DataFrame, left: str, right: str, cost: str, at_once: int = AT_ONCE) -> DataFrame:
    """The pairs that a greedy pass by (cost, left, right) accepts when each left and each right is used once.

    A pair that comes first at both of its ends is always accepted, so a round takes all such pairs and removes their ends: two
    partial minima and two anti joins, however large a group is. What ties and chains leave after ROUNDS rounds falls into connected
    groups, each passed over in order by one task, at_once pairs of a larger one at a time (its first ones, which depend on no
    others). So it ends for any input. Pairs with null ends or cost are ignored."""
    rest = materialize(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(cost).isNotNull()).dropDuplicates([left, right]), "pairs")
    out = None
    order = F.struct(cost, left, right)
    for turn in count():
        if rest.isEmpty():
            return out if out is not None else rest
        if turn < ROUNDS:
            by_left = rest.groupBy(left).agg(F.min(order).alias("first")).select("first")
            by_right = rest.groupBy(right).agg(F.min(order).alias("first")).select("first")
            first = by_left.join(by_right, "first").select(f"first.{left}", f"first.{right}")
            took = materialize(rest.join(first, [left, right], "left_semi"), "taken")
        else:
            took = materialize(_pass_over_groups(rest, left, right, cost, at_once), "taken")
        out = took if out is None else out.unionByName(took)
        rest = materialize(rest.join(took.select(left), left, "left_anti").join(took.select(right), right, "left_anti"), "pairs")


def _connected(ends: DataFrame, a: Column, b: Column) -> DataFrame:
    """ends with _group, the connected group of their ends a and b (hashes; groups whose hashes meet count as one)."""
    e = materialize(ends.withColumn("_a", a).withColumn("_b", b), "ends")
    nodes = e.select(F.col("_a").alias("id")).unionByName(e.select(F.col("_b").alias("id"))).distinct()
    group = components(nodes, e.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return e.join(group.select(F.col("id").alias("_a"), F.col("root").alias("_group")), "_a").drop("_a", "_b")


def _pass_over_groups(pairs: DataFrame, left: str, right: str, cost: str, at_once: int) -> DataFrame:
    grouped = materialize(_connected(pairs, F.xxhash64(F.lit(0), left), F.xxhash64(F.lit(1), right)), "grouped")
    if grouped.groupBy("_group").count().where(F.col("count") > at_once).isEmpty():
        first = grouped
    else:
        first = number(grouped, [cost, left, right], "_place", "_group").where(F.col("_place") <= at_once)
    names = pairs.columns
    rows = first.select("_group", *names).repartition("_group").sortWithinPartitions("_group", cost, left, right)

    def accept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used_left, used_right = None, set(), set()
        for frame in frames:
            keep = []
            for g, a, b in zip(frame["_group"], frame[left], frame[right], strict=True):
                if g != group:
                    group, used_left, used_right = g, set(), set()
                fine = a not in used_left and b not in used_right
                if fine:
                    used_left.add(a)
                    used_right.add(b)
                keep.append(fine)
            yield frame.loc[keep, names]

    return rows.mapInPandas(accept, pairs.schema)


def nearest_pairs(pairs: DataFrame, left: str, right: str, cost: str, below: float) -> DataFrame:
    """Each left's right of the smallest cost strictly under below, ties to the smaller right; lefts without one are dropped."""
    best = F.min(F.struct(cost, right)).alias("b")
    return pairs.where(F.col(cost) < below).groupBy(left).agg(best).select(left, f"b.{right}", f"b.{cost}")


def first_unused(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Each left in its order takes the first right (in its order) of its pairs that no earlier left took."""
    return greedy_pairs(pairs.select(left, right).withColumn("_turn", F.col(left)), left, right, "_turn").drop("_turn")


def first_unused_near(left_rows: DataFrame, right_rows: DataFrame, reach: float, key: str, left: str, right: str, at_once: int = AT_ONCE) -> DataFrame:
    """(left, right): each of left_rows(key, left, lon, lat) in its order takes the first (in its order) of right_rows(key, right, rlon, rlat)
    of its key within reach degrees that no earlier one took.

    A key of at most at_once rows is passed over in one task, which forms no pairs beyond those of one left at a time; those of larger keys
    are formed and passed over as first_unused does."""
    a = left_rows.select(key, left, "lon", "lat").where(F.col(left).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    b = right_rows.select(key, right, "rlon", "rlat").where(F.col(right).isNotNull() & F.col("rlon").isNotNull() & F.col("rlat").isNotNull())
    a, b = materialize(a, "left"), materialize(b, "right")
    large = a.select(key).unionByName(b.select(key)).groupBy(key).count().where(F.col("count") > at_once).select(key)
    large = materialize(large, "large")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((a, left), (b, right)))

    def passed(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        one, other = one.sort_values(left), other.sort_values(right)
        x, y = other["rlon"].to_numpy(), other["rlat"].to_numpy()
        cells: dict[tuple[int, int], list[int]] = {}
        for k, at in enumerate(zip(np.floor(x / reach).astype(int).tolist(), np.floor(y / reach).astype(int).tolist(), strict=True)):
            cells.setdefault(at, []).append(k)
        around: dict[tuple[int, int], np.ndarray] = {}
        used, took = np.zeros(len(other), bool), np.full(len(one), -1)
        lon, lat = one["lon"].to_numpy(), one["lat"].to_numpy()
        for k, (px, py) in enumerate(zip(lon.tolist(), lat.tolist(), strict=True)):
            cx, cy = math.floor(px / reach), math.floor(py / reach)
            if (near := around.get((cx, cy))) is None:
                near = around[cx, cy] = np.array(sorted(n for i in (-1, 0, 1) for j in (-1, 0, 1) for n in cells.get((cx + i, cy + j), ())), int)
            dx, dy = px - x[near], py - y[near]
            free = ~used[near] & (dx * dx + dy * dy <= reach * reach)
            if free.any():
                took[k] = near[int(np.argmax(free))]
                used[took[k]] = True
        fine = took >= 0
        return pd.DataFrame({left: one[left].to_numpy()[fine], right: other[right].to_numpy()[took[fine]]})

    def whole(one: DataFrame, other: DataFrame) -> DataFrame:
        return one.groupBy(key).cogroup(other.groupBy(key)).applyInPandas(passed, kinds)

    if large.isEmpty():
        return whole(a, b)
    out = whole(a.join(large, key, "left_anti"), b.join(large, key, "left_anti"))
    pairs = spatial.near(a.join(large, key, "left_semi"), b.join(large, key, "left_semi"), reach, [key])
    return out.unionByName(first_unused(pairs, left, right))


def kept_apart(nodes: DataFrame, conflicts: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Nodes (id) that a pass in the order of id keeps: one goes if it conflicts(a, b) with an earlier kept one.

    A node with no earlier undecided neighbour is decided at once, so each round settles all of those: joins on conflicts only. After
    ROUNDS rounds connected groups of at most at_once conflicts are passed over in order, one task each; larger ones keep to rounds,
    which end since each decides the first open node of every group at least."""
    both = conflicts.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")).where("late <> early").distinct()
    open_ = materialize(both, "conflicts")
    gone = None
    for turn in count():
        if open_.isEmpty():
            return nodes if gone is None else nodes.join(gone.withColumnRenamed("late", "id"), "id", "left_anti")
        if turn % (4 * ROUNDS) == ROUNDS:
            grouped = materialize(_connected(open_, F.xxhash64("late"), F.xxhash64("early")), "grouped")
            small = grouped.groupBy("_group").count().where(F.col("count") <= at_once).select("_group")
            out = materialize(_gone_in_groups(grouped.join(small, "_group")), "gone")
            rest = grouped.join(small, "_group", "left_anti").select("late", "early")
        else:
            # earlier ends that are later in no open conflict are kept: their later ends go
            waits = open_.select(F.col("late").alias("early")).distinct()
            settled = open_.join(waits, "early", "left_anti")
            out = materialize(settled.select("late").distinct(), "gone")
            rest = open_
        gone = out if gone is None else gone.unionByName(out)
        # conflicts of a node that has gone bind no one
        open_ = materialize(rest.join(out, "late", "left_anti").join(out.withColumnRenamed("late", "early"), "early", "left_anti"), "conflicts")


def _gone_in_groups(grouped: DataFrame) -> DataFrame:
    rows = grouped.select("_group", "late", "early").repartition("_group").sortWithinPartitions("_group", "late", "early")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, gone = None, set()
        for frame in frames:
            new = []
            for g, late, early in frame.itertuples(index=False):
                if g != group:
                    group, gone = g, set()
                if late not in gone and early not in gone:
                    gone.add(late)
                    new.append(late)
            yield pd.DataFrame({"late": pd.Series(new, dtype=frame["late"].dtype)})

    return rows.mapInPandas(decide, grouped.select("late").schema)


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """Pairs (a, b), a < b, of segments (id, x0, y0, x1, y1) with interiors that cross in one point.

    Each segment is listed in the cells that its box touches; a pair is compared only in the smallest cell that both
    boxes touch, so it comes once and no distinct is needed."""
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    s = segments.select("id", "x0", "y0", "x1", "y1", at(F.least("x0", "x1")).alias("cl"), at(F.greatest("x0", "x1")).alias("cr"), at(F.least("y0", "y1")).alias("cb"), at(F.greatest("y0", "y1")).alias("ct"))
    s = s.withColumn("cx", F.explode(F.sequence("cl", "cr"))).withColumn("cy", F.explode(F.sequence("cb", "ct"))).drop("cr", "ct")
    keys = ["cx", "cy"]
    a, b = (s.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in s.columns if c not in keys]) for p in "ab")
    j = a.join(b, keys).where((F.col("a_id") < F.col("b_id")) & (F.col("cx") == F.greatest("a_cl", "b_cl")) & (F.col("cy") == F.greatest("a_cb", "b_cb")))
    p = {k: [F.col(f"{k}_{c}") for c in ("x0", "y0", "x1", "y1")] for k in "ab"}
    apart = [_side(*p[m], *p[n][:2]) * _side(*p[m], *p[n][2:]) for m, n in (("a", "b"), ("b", "a"))]
    return j.where((apart[0] < 0) & (apart[1] < 0)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
