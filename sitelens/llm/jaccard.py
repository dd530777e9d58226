"""N-gram Jaccard join: MinHash banding chosen for a target recall, candidates verified on full sets of word n-grams.

A word is a run of ASCII letters and digits or non-ASCII characters of the lower-cased text; the set holds every n-gram of n words
(texts of fewer words: one gram of all of them). Rows with equal sets are one class. Class representatives meet where a band hash is equal;
only (band, hash, class) is shuffled for that. Candidate components are then verified whole: texts come once to each pair of blocks
of a component (one block for nearly all), intersections are counted there exactly, and only link counts and local classes leave.

Recall: a pair of similarity s is found if any band agrees or a chain of candidates joins the two; at s = threshold the
bands alone give ``recall``.

Defined results: texts without words and rows without doc_id link with nothing and are their own component; equal sets link;
repeated rows count as further rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, fresh, materialize, table
from .pivot_index import _local_labels
from .vectors import groups
from .words import parts

GRAM, THRESHOLD, RECALL, ROWS, BLOCK, _PART = 5, 0.8, 0.9999, 5, 512, 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def band_count(threshold: float, recall: float, rows: int) -> int:
    """Bands of so many rows that a pair at the threshold shares one with probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: list[str | None], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, one text after the other, and where each text's begin (and the end)."""
    joined = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(x) + 1 for x in joined])
    b = np.frombuffer(b"\n".join(joined), np.uint8)
    inside = np.concatenate([[False], _WORD[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = edge[::2], edge[1::2]
    # a word's hash: its bytes' mixed values, weighted by the place in the word
    place = np.zeros(len(b), np.int64)
    place[lo] = lo
    place = np.arange(len(b)) - np.maximum.accumulate(place)
    value = _mix((b.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    words = _mix(sums[hi] - sums[lo] + (hi - lo).astype(np.uint64))
    first = np.searchsorted(lo, starts)  # of each text, and the end
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        out = _mix(out + words[k : k + len(out)])
    sets: list[np.ndarray] = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= n:
            g = np.sort(out[i : j - n + 1])
            sets.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif j > i:
            g = np.zeros(1, np.uint64)
            for w in words[i:j]:
                g = _mix(g + w)
            sets.append(g)
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum([0] + [len(g) for g in sets])


def grams(text: str | None, n: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of one text's word n-grams."""
    return gram_sets([text], n)[0]


def signatures(x: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of sets (none empty) that lie one after the other from starts on: one row a set."""
    rng = np.random.default_rng(17)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.empty((bands * rows, len(starts)), np.uint64)
    ends = np.append(starts[1:], len(x))
    i = 0
    while i < len(starts):  # sets that fit a core's cache together
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PART, side="right")))
        part, at = x[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        y, z = np.empty_like(part), np.empty_like(part)
        for k in range(len(a)):
            np.multiply(part, a[k], out=y)
            np.right_shift(y, np.uint64(31), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint64(0x94D049BB133111EB), out=y)
            low[k, i:j] = np.minimum.reduceat(y, at)
        i = j
    out = np.zeros((bands, len(starts)), np.uint64)
    for r in range(rows):
        out = _mix(out * np.uint64(3) + low[r::rows])
    return _mix(out + np.arange(bands, dtype=np.uint64)[:, None]).T.view(np.int64)


def _counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of intersections of the sets a with b (None: a itself), by products over the grams that repeat."""
    every = a + (b or [])
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, at, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    again = n[at] > 1
    owner, at = owner[again], at[again]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(a), len(b) if b is not None else len(a)), np.float64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((len(every), 4096), np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        total += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    return total


def similar(docs: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_links (other rows at or above threshold), component_id, kept."""
    bands = band_count(threshold, recall, rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in parts(b.column(1)):
                x, bounds = gram_sets(texts, n)
                some = np.flatnonzero(np.diff(bounds))
                starts = bounds[:-1][some]
                sig = signatures(x, starts, bands, rows)
                keys = [np.add.reduceat(_mix(x + np.uint64(salt)), starts).view(np.int64) if len(some) else np.zeros(0, np.int64) for salt in (0, 99)]
                none = np.ones(len(texts), bool)
                none[some] = False
                wide = []
                for key in keys:
                    full = np.zeros(len(texts), np.int64)
                    full[some] = key
                    wide.append(pa.array(full, mask=none))
                offsets = np.concatenate([[0], np.cumsum(~none)]) * bands
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(sig).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *wide, lists], ["doc_id", "k1", "k2", "bands"])
                at += len(texts)

    every = materialize(docs.mapInArrow(describe, "doc_id long, k1 long, k2 long, bands array<long>"), "signatures")
    members = every.where("doc_id IS NOT NULL AND k1 IS NOT NULL")
    classes = materialize(members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes")
    at = classes.select("rep", F.explode("bands").alias("band"))
    low = at.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").drop("high")
    stars = at.join(low, "band").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    # one doc_id with several texts has several classes: they are one node, verified text by text
    coarse = materialize(connected(stars), "candidates")
    sizes = coarse.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wanted = classes.join(coarse.withColumnRenamed("node", "rep").join(sizes, "component"), "rep").select("rep", "k1", "k2", "n", "component", "blocks")
    # the representative's text is fetched by doc_id; its own keys tell apart texts that share a doc_id
    texts = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
    texts = texts.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "k1"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.select("component", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "doc_id", "n", F.col("own").cast("long"), "k1", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), slices in groups(batches, 3):
            kept: dict[int, tuple] = {}
            for p in slices:
                x, bounds = gram_sets(p.column("text").to_pylist(), n)
                for i, (doc, many, own, key) in enumerate(zip(*(p.column(c).to_pylist() for c in ("doc_id", "n", "own", "k1")), strict=True)):
                    g = x[bounds[i] : bounds[i + 1]]
                    if len(g) and int(_mix(g).sum(dtype=np.uint64).view(np.int64)) == key:  # not another text of this doc_id
                        kept[key] = (doc, many, own, g, key)
            left = [v for v in kept.values() if v[2] == lo]
            right = [v for v in kept.values() if v[2] == hi] if lo != hi else left
            if not left or not right or len(left) + len(right) < 3 and lo == hi:
                continue
            shared = _counts([v[3] for v in left], [v[3] for v in right] if lo != hi else None)
            na, nb = (np.array([len(v[3]) for v in side], float) for side in (left, right))
            near = shared >= threshold * (na[:, None] + nb[None, :] - shared) - 1e-9
            if lo == hi:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            (ia, ma), (ib, mb) = (tuple(np.array([v[c] for v in side], np.int64) for c in (0, 1)) for side in (left, right))
            la, lb = _local_labels(near, ia, ib)
            out = [(ia, near @ mb, la, left)] + ([] if lo == hi else [(ib, near.T @ ma, lb, right)])
            for ids, links, low_, side in out:
                key = [v[4] for v in side]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key, pa.int64()), pa.array(links.astype(np.int64)), pa.array(low_.astype(np.int64))], ["rep", "k1", "links", "low"])

    found = texts.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(verify, "rep long, k1 long, links long, low long")
    found = materialize(found.where("links > 0 OR low <> rep"), "found")
    links = found.groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    # rows of one class or one doc_id hang together
    same = members.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = members.groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("c")).where("c > 1").select("doc_id")
    odd = same.join(repeated, same.a == repeated.doc_id, "left_semi")
    linked = connected(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(odd).distinct())
    of = classes.select("k1", "k2", "rep", "n").join(links, ["rep", "k1"], "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = every.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(of, ["k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the row with the smallest doc_id stays (nulls last, of equal ids one row).
    Rows are told apart by numbers of their own; rows without words all stay."""
    (row,) = fresh(docs.columns, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups_ = similar(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    ids = rows.select(F.col(row).alias("node"), F.col("doc_id").cast("long").alias("id")).join(groups_, "node")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("m"), F.count("*").alias("n")).where("n > 1")
    gone = ids.join(first.select("component_id", F.col("m.node").alias("stays")), "component_id").where("node <> stays").select(F.col("node").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
