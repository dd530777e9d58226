"""Embedding near-dedup by a pivot-permutation index.

Every distinct vector is described by its nearest reference points (the head of its permutation of PIVOTS pivots), seen from the
sample's mean, since vectors that lie to one side of the origin all have the same pivots ahead. Inverted lists are kept for sets of
pivots: two vectors meet in a list exactly when their heads share at least that many. A pair is verified in the first list that it
shares only, by cosine of the original vectors in double precision. Lists longer than BLOCK rows are split into blocks that meet
pairwise, so no task holds a whole hot list, and blocks give counts and local classes, never rows of pairs.

How long heads are and how many pivots a pair must share is the first step of LADDER with a recall of RECALL on the sample (at most
SAMPLE rows): on its own pairs at the threshold or over, and on pairs made of a row and its turn towards another one, just over the
threshold. Where vectors lie so far off the origin that no step finds enough (then a great part of all pairs links), there is one
list, so all blocks meet. Pivots are a bounded sample too (PIVOTS rows, mutually below the threshold).

Vectors link with those of their own length only; the pivots of the most frequent length come from the sample, those of others are
drawn at random from a seed that is the length.

Defined results: rows with null, zero or non-finite vectors or null ids link with nothing and are their own component; equal vectors
are linked to each other; repeated rows count as further vectors; different vectors of one vec_id have counts of their own and one
component; a null vec_id gives a null component that is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, materialize, table
from .vectors import finite, groups

PIVOTS, BLOCK, SAMPLE, RECALL = 256, 1024, 4096, 0.95
#: (pivots that a pair must share, length of heads), from the fewest comparisons to the most; (0, 1) is one list of all.
LADDER = ((2, 7), (2, 10), (1, 12), (1, 20), (1, 32), (0, 1))


def choose_pivots(rows: np.ndarray, count: int, apart: float) -> np.ndarray:
    """Greedily the first rows whose cosine with all chosen is below apart, filled up at random."""
    chosen = np.zeros((0, rows.shape[1] if rows.ndim == 2 else 0))
    for r in rows:
        if len(chosen) >= count:
            break
        if not len(chosen) or (chosen @ r).max() < apart:
            chosen = np.vstack([chosen, r])
    if len(chosen) < count and rows.size:
        extra = np.random.default_rng(5).normal(size=(count - len(chosen), rows.shape[1]))
        chosen = np.vstack([chosen, extra / np.linalg.norm(extra, axis=1)[:, None]])
    return chosen


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _heads(u: np.ndarray, mean: np.ndarray | float, ref: np.ndarray, head: int) -> np.ndarray:
    """The nearest pivots of unit vectors, seen from the mean, nearest first."""
    return np.argsort(-(_unit(u - mean) @ ref.T), axis=1, kind="stable")[:, :head]


def choose_step(u: np.ndarray, mean: np.ndarray, ref: np.ndarray, threshold: float, ladder: tuple = LADDER, recall: float = RECALL) -> tuple[int, int]:
    """The first step of the ladder that finds enough of the sample's pairs, natural and made ones."""
    if len(u) < 3:
        return ladder[0]
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, len(u), (2, 1024))
    side = u[j] - u[i]
    side = _unit(side - (side * u[i]).sum(axis=1, keepdims=True) * u[i])
    c = threshold + (1 - threshold) * 0.2 * rng.random((len(i), 1))
    turned = c * u[i] + np.sqrt(1 - c * c) * side
    own = _heads(u, mean, ref, len(ref))
    made = own[i], _heads(turned, mean, ref, len(ref)), np.ones(len(i), bool)
    pairs = [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(u), 512):
        a, b = np.nonzero(u[lo : lo + 512] @ u.T >= threshold)
        keep = a + lo < b
        pairs.append(np.stack([a[keep] + lo, b[keep]]))
    natural = np.concatenate(pairs, axis=1)
    natural = natural[:, rng.permutation(natural.shape[1])[:4096]]
    checks = [made[:2]] + ([(own[natural[0]], own[natural[1]])] if natural.shape[1] >= 50 else [])

    def found(a: np.ndarray, b: np.ndarray, shared: int, head: int) -> float:
        has = np.zeros((2, len(a), len(ref)), bool)
        for k, x in enumerate((a, b)):
            has[k, np.arange(len(x))[:, None], x[:, :head]] = True
        return float(((has[0] & has[1]).sum(axis=1) >= shared).mean())

    return next((s for s in ladder if all(found(a, b, *s) >= recall for a, b in checks)), ladder[-1])


def _local_labels(near: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id in each row's and column's component of the bipartite relation near."""
    a, b, top = ids.copy(), other.copy(), np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(near, a[:, None], top).min(axis=0, initial=top))
        a2 = np.minimum(a, np.where(near, b2[None, :], top).min(axis=1, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, step: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept. A step (pivots shared, length of heads) may be given."""
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(3), "v").alias("k2")]
    members = finite(df, id_col, vec_col).select("vec_id", *key, "v")
    classes = materialize(members.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    dims = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    main, total = (dims[0].d, dims[0]["count"]) if dims else (0, 0)
    cut = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = classes.where(F.size("v") == main).where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= cut).select("rep", "v").collect()
    x = np.array([r.v for r in sorted(sample, key=lambda r: r.rep)], float)
    x = x / np.abs(x).max(axis=1, keepdims=True) if x.size else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if x.size else x
    mean = x.mean(axis=0) if x.size else 0.0
    ref = choose_pivots(np.random.default_rng(2).permutation(_unit(x - mean)), pivots, threshold)
    shared, head = step or choose_step(x, mean, ref, threshold)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = pc.list_value_length(b.column(2)).to_numpy()
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                own = ref if d == main else np.random.default_rng(d).normal(size=(pivots, d))
                u = v / np.abs(v).max(axis=1, keepdims=True)
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                heads = np.sort(_heads(u, mean if d == main else 0.0, own, head), axis=1)
                sets = np.array(list(combinations(range(heads.shape[1]), shared)), np.int64)
                lists = np.full((len(u), len(sets)), d * pivots**2, np.int64)
                for k in range(shared):
                    lists += heads[:, sets[:, k]] * pivots ** (shared - 1 - k)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rep", "k1", "n")), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(heads.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(lists.tolist(), pa.list_(pa.int64()))],
                    ["rep", "k1", "n", "u", "head", "lists"],
                )

    described = materialize(classes.select("rep", "n", "v", "k1").mapInArrow(describe, "rep long, k1 long, n long, u binary, head array<int>, lists array<long>"), "described")
    rows = described.select(F.explode("lists").alias("list"), "rep", "k1", "n", "u", "head")
    # At most PIVOTS^2 lists for each length of vectors: bounded by the model unless lengths are very many
    sizes = rows.groupBy("list").count().where("count > 1").select("list", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    sizes = materialize(sizes, "sizes")
    small = sizes.count() <= 4 * pivots * pivots
    rows = rows.join(F.broadcast(sizes) if small else sizes, "list").withColumn("own", F.pmod(F.xxhash64(F.lit(9), "k1"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "rep", "k1", "n", "u", "head", "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lst, lo, hi), parts in groups(batches, 3):
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, key, n, own = (t.column(c).to_numpy().astype(np.int64) for c in ("rep", "k1", "n", "own"))
            u = np.frombuffer(b"".join(t.column("u").to_pylist()), np.float64).reshape(len(ids), -1)
            has = np.zeros((len(ids), pivots), np.float32)
            has[np.arange(len(ids))[:, None], np.array(t.column("head").to_pylist())] = 1
            i, j = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            near = u[i] @ u[j].T >= threshold
            if near.any() and shared:
                last = int(lst % pivots) + 1
                near &= has[i, :last] @ has[j, :last].T == shared  # this is the first list that the two share
            if lo == hi:
                near &= i[:, None] != j[None, :]
            if not near.any():
                continue
            la, lb = _local_labels(near, ids[i], ids[j])
            out = [(ids[i], key[i], near @ n[j], la)] + ([] if lo == hi else [(ids[j], key[j], near.T @ n[i], lb)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["rep", "k1", "links", "low"])

    found = rows.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi", "rep").mapInArrow(verify, "rep long, k1 long, links long, low long")
    found = materialize(found.where("links > 0 OR low <> rep"), "found")
    counts = found.groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    same = members.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    repeated = members.groupBy("vec_id").agg(F.count_distinct("k1", "k2").alias("c")).where("c > 1").select("vec_id")
    odd = same.join(repeated, same.a == repeated.vec_id, "left_semi")
    parts = connected(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(odd).distinct())
    per_class = classes.select("k1", "k2", "rep", "n").join(counts, ["rep", "k1"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    # classes holds no unusable vector, so those rows find none here; an unusable id must not borrow its vector's class
    joined = every.select("vec_id", F.when(F.col("vec_id").isNotNull(), key[0]).alias("k1"), key[1]).join(per_class, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
