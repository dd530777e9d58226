"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

Rows get one more component that gives them all one length, queries a zero there, so the largest inner product is the smallest distance. The
trees are fitted on a bounded sample (``fit_rows``, about; a share of id hashes); every row is indexed in every tree. A query keeps
one queue over all trees, ordered by the summed squared margins that a branch lies beyond, and takes leaves until they hold a share
of the rows, and MARGIN times k rows at least; a row that several trees hold counts once (read off the sample). Where that is every row,
one tree's leaves are all taken. The share is learned: the least at which TRIALS rows of the sample find ``recall`` of their k
best rows in the sample. It depends on how the vectors lie, not on how many there are: the k best of more rows lie nearer, so the
sample's share is on the safe side. Rows of the leaves are ranked exactly in double precision.

A tree has LEAVES leaves until they would pass LEAF_ROWS rows, then more. Leaves with more than BLOCK rows are split into blocks,
leaves with more than BLOCK queries serve them in several groups, so a task's group is bounded. Vectors that lie in no clusters
need a large share; comparisons then grow with rows times queries.

Defined results: rows with null, zero or non-finite vectors, null ids or an odd length take no part; only equal scores go by the
smaller id; fewer candidates give fewer rows; an empty table gives an empty result; other columns are ignored. Rows that repeat an id
are one candidate each and are excluded by id from their own query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import groups, matrix, usable

TREES, FIT_ROWS, LEAVES, LEAF_ROWS, RECALL, TRIALS, MARGIN, BLOCK = 6, 20_000, 64, 4096, 0.95, 200, 64, 4096


@dataclass
class Tree:
    """Arrays by node: split direction and offset, children (-1 in a leaf), sample rows of a leaf."""

    w: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: list[np.ndarray]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            below = np.einsum("ij,ij->i", x[inner], self.w[n]) <= self.cut[n]
            at[inner] = np.where(below, self.left[n], self.right[n])


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    nodes: list[list] = []
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][side] = me
        nodes.append([np.zeros(sample.shape[1]), 0.0, -1, -1, rows])
        if len(rows) <= leaf:
            continue
        w = rng.normal(size=sample.shape[1])
        w /= np.linalg.norm(w)
        p = sample[rows] @ w
        cut = float(np.median(p))
        if not (p <= cut).any() or not (p > cut).any():
            continue
        nodes[me][0], nodes[me][1], nodes[me][4] = w, cut, rows[:0]
        todo += [(rows[p <= cut], me, 2), (rows[p > cut], me, 3)]
    return Tree(*(np.array([n[k] for n in nodes]) for k in range(4)), [n[4] for n in nodes])


def queue_of(trees: list[Tree], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """All leaves (tree, node) in the order of the shared queue."""
    margin = [t.w @ q - t.cut for t in trees]
    queue = [(0.0, k, 0) for k in range(len(trees))]
    while queue:
        far, k, node = heapq.heappop(queue)
        t, m = trees[k], margin[k]
        while t.left[node] >= 0:
            near, other = (t.left[node], t.right[node]) if m[node] <= 0 else (t.right[node], t.left[node])
            heapq.heappush(queue, (far + m[node] ** 2, k, int(other)))
            node = int(near)
        yield k, node


def leaves_for(trees: list[Tree], q: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Leaves in the order of the queue until they hold share of the distinct rows; all of a tree's for 1."""
    if share >= 1:
        return [(0, int(n)) for n in np.flatnonzero(trees[0].left < 0)]
    seen = np.zeros(sum(map(len, trees[0].rows)), bool)
    out, held, want = [], 0, share * len(seen)
    for k, node in queue_of(trees, q):
        if held >= want:
            break
        out.append((k, node))
        rows = trees[k].rows[node]
        held += len(rows) - np.count_nonzero(seen[rows])
        seen[rows] = True
    return out


def learn_share(trees: list[Tree], x: np.ndarray, q: np.ndarray, k: int, recall: float) -> float:
    """The least share of the rows x at which the queries q (the first rows of x) have met recall of their k best others."""
    met: list[np.ndarray] = []
    for i, one in enumerate(q):
        score = x @ one
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        first, held = np.full(len(x), np.inf), 0
        for t, node in queue_of(trees, one):
            rows = trees[t].rows[node]
            rows = rows[first[rows] == np.inf]
            held += len(rows)
            first[rows] = held / len(x)
            if held == len(x):
                break
        met.append(first[best])
    every = np.sort(np.concatenate(met)) if met else np.ones(1)
    return float(every[min(len(every) - 1, int(np.ceil(recall * len(every))))]) if len(every) else 1.0


def lift(v: np.ndarray, scale: float, longest: float, asks: bool) -> np.ndarray:
    """Vectors with the component that makes rows equally long (0 for queries, which are brought to that length)."""
    u = v / scale
    square = np.einsum("ij,ij->i", u, u)
    if asks:
        u = u / np.abs(u).max(axis=1, keepdims=True, initial=1e-300)
        return np.concatenate([u * (np.sqrt(longest) / np.linalg.norm(u, axis=1))[:, None], np.zeros((len(u), 1))], axis=1)
    return np.concatenate([u, np.sqrt(np.maximum(longest - square, 0))[:, None]], axis=1)


def aim(total: int, k: int, share: float) -> float:
    """The share of the distinct rows that a query takes."""
    return max(share, MARGIN * k / max(total, 1))


def search(df: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, fit_rows: int = FIT_ROWS, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, seed: int = 3) -> DataFrame:
    """The k nearest found by inner product: query_id, rank, vec_id, score. df and queries hold (vec_id, embedding)."""
    index, asked = usable(df), usable(queries)
    size = F.array_max(F.transform("v", F.abs))
    total, scale = index.agg(F.count("*"), F.max(size)).first()
    longest = index.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))).first()[0] if total else 0.0
    cut = int(min(1.0, fit_rows / max(total, 1)) * (1 << 30))
    sample = sorted(index.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) <= cut).collect(), key=lambda r: (r.vec_id, r.v))
    rng = np.random.default_rng(seed)
    raw = rng.permutation(np.array([r.v for r in sample], float))
    x = lift(raw, scale, longest, False) if len(raw) else raw
    leaf = min(leaf_rows, total / leaves)
    forest = [grow(x, max(4, round(leaf * len(x) / total)), rng) for _ in range(trees)] if len(x) else []
    trials = lift(raw[:TRIALS], scale, longest, True) if len(raw) else raw
    share = aim(total, k, learn_share(forest, x, trials, k, recall)) if len(raw) > 1 else 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and forest:
                v = lift(matrix(b.column(1)), scale, longest, False)
                at = np.concatenate([(np.int64(i) << 32) | t.leaf_of(v) for i, t in enumerate(forest)])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(b.column(0).to_numpy(), trees))], ["leaf", "vec_id"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and forest:
                ids = b.column(0).to_pylist()
                for lo in range(0, len(ids), 256):
                    took = [leaves_for(forest, q, share) for q in lift(matrix(b.column(1).slice(lo, 256)), scale, longest, True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(t << 32) | n for x in took for t, n in x], pa.int64()), pa.array(np.repeat(np.array(ids[lo : lo + 256], np.int64), [len(x) for x in took]))], ["leaf", "vec_id"]
                    )

    placed = index.mapInArrow(place, "leaf long, vec_id long")
    wanted = asked.mapInArrow(ask, "leaf long, vec_id long")
    # As many rows as the model has leaves: bounded by fit_rows and trees.
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = sizes.join(wanted.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "leaf")
    split = {r.leaf: (r.blocks, r.parts) for r in sizes.collect()}

    def dealt(of_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy()
                for lo in range(0, b.num_rows if forest else 0, 128):
                    part, v = ids[lo : lo + 128], matrix(b.column(1).slice(lo, 128))
                    sent, v = [r.tobytes() for r in v], lift(v, scale, longest, of_query)
                    if of_query:
                        at = [[(t << 32) | n for t, n in leaves_for(forest, q, share)] for q in v]
                    else:
                        at = np.stack([(np.int64(i) << 32) | t.leaf_of(v) for i, t in enumerate(forest)], axis=1).tolist()
                    out: list[tuple] = []
                    for i, (one, leaves) in enumerate(zip(part.tolist(), at, strict=True)):
                        for leaf in leaves:
                            if leaf in split:
                                blocks, parts = split[leaf]
                                if of_query:
                                    out += [(leaf, g, one * 2654435761 % 4294967291 % parts, 1, one, sent[i]) for g in range(blocks)]
                                else:
                                    out += [(leaf, one * 2654435761 % 4294967291 % blocks, p, 0, one, sent[i]) for p in range(parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)

        return run

    names, kinds = ["leaf", "block", "part", "asks", "vec_id", "v"], [pa.int64()] * 5 + [pa.binary()]
    schema = "leaf long, block long, part long, asks long, vec_id long, v binary"
    rows = index.mapInArrow(dealt(False), schema).unionByName(asked.mapInArrow(dealt(True), schema))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in groups(batches, 3):
            t = pa.Table.from_batches(slices).combine_chunks()
            asks, ids = t.column("asks").to_numpy() == 1, t.column("vec_id").to_numpy()
            if asks.all() or not asks.any():
                continue
            v = matrix(t.column("v").chunk(0))
            yield _best(ids[asks], v[asks], ids[~asks], v[~asks], k)

    near = rows.repartition("leaf", "block", "part").sortWithinPartitions("leaf", "block", "part", "asks").mapInArrow(rank, "query_id long, ids binary, scores binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query,), slices in groups(batches, 1):
            ids = np.frombuffer(b"".join(x for s in slices for x in s.column(1).to_pylist()), np.int64)
            scores = np.frombuffer(b"".join(x for s in slices for x in s.column(2).to_pylist()), np.float64)
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            _, first = np.unique(ids, return_index=True)
            first = np.sort(first)[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), query)), pa.array(np.arange(1, len(first) + 1, dtype=np.int32)), pa.array(ids[first]), pa.array(scores[first])], ["query_id", "rank", "vec_id", "score"])

    return near.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of a leaf for each query; scores are summed pair by pair, so equal vectors score equally."""
    s = q @ v.T
    # what rounding in that product may hide
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0)
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    out: tuple[list, list] = ([], [])
    for i in range(len(q_ids)):
        floor = np.partition(s[i], -k)[-k] - slack[i] if len(ids) > k else -np.inf
        at = np.flatnonzero((s[i] >= floor) & (s[i] > -np.inf))
        exact = (q[i] * v[at]).sum(axis=1)
        at_order = np.lexsort((ids[at], -exact))[:k]
        out[0].append(ids[at][at_order].tobytes())
        out[1].append(exact[at_order].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["query_id", "ids", "scores"])


def op10_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
