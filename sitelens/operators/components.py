"""Sets of pixels (x, y): neighbours, growth, openings, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.sources.scratch import materialize


def _around(k: int):
    r = range(-(k // 2), k // 2 + 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in r for j in r])


def dilate(pixels: DataFrame, k: int) -> DataFrame:
    """Pixels within a k x k square around one of the set."""
    near = pixels.select("x", "y", F.explode(_around(k)).alias("d"))
    return near.select((F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y")).distinct()


def erode(pixels: DataFrame, k: int) -> DataFrame:
    """Pixels whose whole k x k square lies in the set of distinct pixels."""
    near = pixels.select("x", "y", F.explode(_around(k)).alias("d"))
    held = near.groupBy((F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y")).agg(F.count("*").alias("n"))
    return held.where(F.col("n") == k * k).select("x", "y")


def opening(pixels: DataFrame, k: int) -> DataFrame:
    return dilate(erode(pixels, k), k)


def closing(pixels: DataFrame, k: int) -> DataFrame:
    return erode(dilate(pixels, k), k)


def links(pixels: DataFrame, wide: bool) -> DataFrame:
    """Pairs (a, b) of ids of neighbouring pixels (id, x, y): 8 neighbours where wide, else 4; each pair once."""
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if wide else [])
    next_to = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    a = pixels.select(F.col("id").alias("a"), "x", "y", F.explode(next_to).alias("d"))
    a = a.select("a", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"))
    return a.join(pixels.select(F.col("id").alias("b"), "x", "y"), ["x", "y"]).select("a", "b")


def components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root) for each node: the smallest id that pairs(a, b) reach.

    Every round each node takes the smallest root among its neighbours' and then its root's root, so a chain halves; rounds end when
    no root changes, and raise if they do not. Minima are combined before each shuffle."""
    both = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = materialize(nodes.select("id", F.col("id").alias("root")), "roots")
    for _ in range(max_rounds):
        seen = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        now = roots.join(seen, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was"))
        # what a root's own neighbours found goes to all that it roots
        hooks = now.groupBy(F.col("was").alias("id")).agg(F.min("root").alias("hook"))
        now = now.join(hooks, F.col("was") == hooks["id"]).select(now["id"], F.least("root", "hook").alias("root"), "was")
        up = now.select(F.col("id").alias("root"), F.col("root").alias("above"))
        now = materialize(now.join(up, "root").select("id", F.col("above").alias("root"), F.col("was").alias("before")), "roots")
        if now.where("root <> before").isEmpty():
            return now.select("id", "root")
        roots = now.select("id", "root")
    raise RuntimeError(f"components: roots still change after {max_rounds} rounds")
