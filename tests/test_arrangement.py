import random
import time

import numpy as np

from sitelens.operators import overlay

SCHEMA = "key long, side int, ring array<struct<x:bigint,y:bigint>>"


def _star(r, size, n):
    """A concave ring around the origin, anticlockwise."""
    turns = np.sort([r.random() for _ in range(n)]) * 2 * np.pi
    return [(int(size * q * np.cos(t)), int(size * q * np.sin(t))) for t, q in zip(turns, [r.uniform(0.5, 1) for _ in range(n)])]


def _area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _areas(df):
    out = {}
    for key, ring in df.collect():
        out[key] = out.get(key, 0) + _area([(p.x, p.y) for p in ring])
    return out


def test_no_ring_is_lost_where_roundings_meet(spark):
    """Union and intersection have the area of both together, but for roundings; a crossing that is not split leaves a ring open."""
    r = random.Random(3)
    pairs = [(key, _star(r, 900, 40), _star(r, 900, 40)) for key in range(150)]
    rows = [(k, s, [{"x": x, "y": y} for x, y in ring]) for k, *both in pairs for s, ring in enumerate(both)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    whole, shared = (_areas(overlay.overlay(df, op)) for op in ("union", "intersection"))
    dealt = _areas(overlay.overlay(df, "union", 512, 60, 10))
    for key, a, b in pairs:
        both = _area(a) + _area(b)
        assert abs(whole[key] + shared[key] - both) < 0.005 * both
        assert abs(whole[key] - dealt[key]) < 0.005 * both


def test_many_small_keys_are_worked_out_together(spark):
    """60,000 keys of two boxes each: some 20 s of one core when each is an arrangement of its own."""
    from pyspark.sql import functions as F

    box = lambda at: F.array(*[F.struct((F.lit(at) + x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    df = spark.range(60_000).select(F.col("id").alias("key"), F.explode(F.array(F.struct(F.lit(0).alias("side"), box(0).alias("ring")), F.struct(F.lit(1).alias("side"), box(2).alias("ring"))))).select("key", "col.*")
    df = df.repartition(1)
    overlay.overlay(df.limit(10), "union").count()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.time()
        found = overlay.measured(overlay.overlay(df, "difference"), "key").groupBy("area", "border").count().collect()
        took = time.time() - began
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [tuple(x) for x in found] == [(8.0, 12.0, 60_000)]
    assert took < 15
