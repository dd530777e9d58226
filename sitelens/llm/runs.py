"""Periodic runs of words by an enhanced suffix array and the branching-tandem test.

A run of period q and at least ``reps`` * q words, ``least`` or more in all, shares itself with its own shift by q: two of its suffixes
agree on max(least, reps * q) - q words, which is never below floor(least * (reps - 1) / reps). Texts in which no two stretches of that
many words agree (by hash; a collision only costs time) hold no run. The others get a suffix array of their words (prefix
doubling over all texts of a batch, each with its own end), the ranks of all doublings give the neighbours' common prefixes, and a range
minimum gives each interval's ends: intervals of depth d with their children are ranges of the array, no tree is built. For
every suffix i of an interval's children but the largest, the inverse array tells whether i + d or i - d lies in another child: then
a square of period d starts at the smaller of the two and cannot be moved to the right. Squares are rotated to the left as far as words
agree, that is the run; squares of one end whose period is a multiple of a found run's merge into it.

Defined results: null and empty texts have no words; a text with fewer than ``least`` words has no run; repeated rows get equal
results; null ids stay null; empty tables give no rows; other columns, whatever their names, are ignored. A text is read whole in one task;
texts are taken together up to PART bytes, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, REPS, PART = 24, 3, 1 << 20
_M = np.uint64(0xD1342543DE82EF95)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def repeating(codes: np.ndarray, text: np.ndarray, span: int) -> np.ndarray:
    """Numbers of the texts in which a stretch of span words occurs twice (or seems to, by hash); text is the text of each word."""
    n = len(codes) - span + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h, done = _mix(codes.astype(np.uint64) + np.uint64(1)), 1
    while done < span:  # hashes of twice the length, the last step overlaps
        step = min(done, span - done)
        h = _mix(h[:-step] * _M + h[step:])
        done += step
    inside = text[:n] == text[span - 1 :]
    h, of = _mix(h + text[:n].astype(np.uint64) * _M)[inside], text[:n][inside]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.unique(of[order[1:][same]])


def suffix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols; the last ones are all different."""
    _, rank = np.unique(codes, return_inverse=True)
    levels, h, n = [rank.astype(np.int32)], 1, len(codes)
    open_ = np.flatnonzero(np.bincount(rank)[rank] > 1)
    while len(open_):
        old = levels[-1].astype(np.int64)
        # ranks are places of a group's first, so groups are refined where they stand
        if h == 1:
            sizes = np.bincount(old)
            old = (np.cumsum(sizes) - sizes)[old]
            levels[-1] = old.astype(np.int32)
        key = old[open_] * (n + 1) + old[np.minimum(open_ + h, n - 1)]
        order = np.argsort(key, kind="stable")
        at, key, group = open_[order], key[order], old[open_][order]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank = levels[-1].copy()
        rank[at] = group + (first - start)
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = np.sort(at[np.repeat(size > 1, size)])
        h *= 2
    if len(levels) == 1:
        sizes = np.bincount(levels[0])
        levels[0] = (np.cumsum(sizes) - sizes)[levels[0]].astype(np.int32)
    return levels


def common_prefixes(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array (0 for the first), from the ranks of all doublings."""
    i, j = sa[:-1].astype(np.int64), sa[1:].astype(np.int64)
    out, last = np.zeros(len(i), np.int64), len(sa) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][np.minimum(i, last)] == levels[k][np.minimum(j, last)]) & (i <= last) & (j <= last)
        step = np.where(same, 1 << k, 0)
        out, i, j = out + step, i + step, j + step
    return np.concatenate([[0], out])


def _nearest_below(lcp: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the last place before it and the first after it whose lcp is under value (-1 and n where there is none)."""
    tables, span = [lcp], 1
    while 2 * span <= len(lcp):
        t = tables[-1]
        tables.append(np.minimum(t[:-span], t[span:]))
        span *= 2
    left, right = at.copy(), at + 1  # all of lcp[left .. right - 1] is at least value
    for k in range(len(tables) - 1, -1, -1):
        t, span = tables[k], 1 << k
        lo = left - span
        left = np.where((lo >= 0) & (t[np.maximum(lo, 0)] >= value), lo, left)
        right = np.where((right + span <= len(lcp)) & (t[np.minimum(right, len(t) - 1)] >= value), right + span, right)
    return left - 1, right


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these lengths laid end to end: the item of each element and its place within."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def squares(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that cannot be moved to the right. Codes of different texts differ, each text ends in a code of its own."""
    levels = suffix_ranks(codes)
    isa, n = levels[-1].astype(np.int64), len(codes)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = common_prefixes(levels, sa)
    del levels
    cut = np.flatnonzero(lcp > 0)  # each cut divides two children of the interval in which it is least
    if not len(cut):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = lcp[cut]
    below, above = _nearest_below(lcp, cut, depth)
    lo, hi = np.maximum(below, 0), above - 1
    # the cuts of one interval in order: children lie between them
    order = np.lexsort((cut, hi, lo))
    cut, depth, lo, hi = cut[order], depth[order], lo[order], hi[order]
    head = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    interval = np.cumsum(head) - 1
    lo, hi, depth_of = lo[head], hi[head], depth[head]
    # children: one per cut (what follows it), and the first of each interval
    ends = np.where(np.append(head[1:], True), hi[interval], np.append(cut[1:], 0) - 1)
    first_end = cut[head] - 1
    child_lo, child_hi = np.concatenate([lo, cut]), np.concatenate([first_end, ends])
    owner = np.concatenate([np.arange(len(lo)), interval])
    size = child_hi - child_lo + 1
    # all but the largest child (the last of equal ones) of each interval
    by = np.lexsort((size, owner))
    largest = np.append(owner[by][1:] != owner[by][:-1], True)
    chosen = by[~largest]
    child_lo, child_hi, owner, size = child_lo[chosen], child_hi[chosen], owner[chosen], size[chosen]
    starts, periods = [], []
    for a, b in _slices(size, 1 << 22):
        of, place = _pieces(size[a:b])
        of += a
        i, own = sa[child_lo[of] + place], owner[of]
        d = depth_of[own]
        for sign in (1, -1):
            j = i + sign * d
            fine = (j >= 0) & (j < n)
            where = isa[np.where(fine, j, 0)]
            fine &= (where >= lo[own]) & (where <= hi[own]) & ((where < child_lo[of]) | (where > child_hi[of]))
            starts.append(np.minimum(i, j)[fine])
            periods.append(d[fine])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about most."""
    part = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True) if len(size) else iter(())


def _rotate(codes: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The smallest starts to which squares can be moved: words before them agree with those a period later."""
    out, live, step = start.copy(), np.arange(len(start)), 16
    while len(live):
        going = []
        for part in np.array_split(live, len(live) * step // (1 << 21) + 1):
            at = out[part, None] - 1 - np.arange(step)
            inside = np.maximum(at, 0)
            same = (at >= 0) & (codes[inside] == codes[inside + period[part, None]])
            moved = np.where(same.all(axis=1), step, (~same).argmax(axis=1))
            out[part] -= moved
            going.append(part[moved == step])
        live, step = np.concatenate(going), min(2 * step, 4096)
    return out


def maximal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs of at least two periods, each once."""
    start, period = squares(codes)
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    found = []
    while len(start):  # the smallest period of each end, then those that are no multiple of it
        head = np.concatenate([[True], end[1:] != end[:-1]])
        of = np.cumsum(head) - 1
        left, q = _rotate(codes, start[head], period[head]), period[head]
        found.append((left, end[head], q))
        rest = ~head & ((period % q[of] != 0) | (start < left[of]))
        start, period, end = start[rest], period[rest], end[rest]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def word_codes(joined: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Code of each word and its text, of texts whose words are parted by one space; the number of codes."""
    some = [i for i, t in enumerate(joined) if t]
    if not some:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    data = np.frombuffer(b" ".join(joined[i] for i in some), np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    sizes = np.diff(np.concatenate([[-1], gaps, [len(data)]])) - 1
    solid = np.ascontiguousarray(data[data != 0x20])
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
    words = np.array([joined[i].count(b" ") + 1 for i in some])
    return coded.indices.to_numpy().astype(np.int64), np.repeat(some, words), len(coded.dictionary)


def runs_of(texts: list[bytes], least: int = LEAST, reps: int = REPS) -> tuple[list[bytes], list[list[tuple[int, int, int]]]]:
    """Each text with its words parted by one space, and its runs (start, length, period) in order."""
    joined = [b" ".join(t.split()) for t in texts]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    codes, text, kinds = word_codes(joined)
    deep = repeating(codes, text, max(1, least * (reps - 1) // reps))
    first, last = np.searchsorted(text, deep), np.searchsorted(text, deep, side="right")
    for a, b in _slices(last - first + 1, PART // 8):
        # every word and every end is a symbol of its text alone
        whole = [np.append(codes[i:j], kinds) + (kinds + 1) * k for k, (i, j) in enumerate(zip(first[a:b], last[a:b], strict=True))]
        base = np.cumsum([0, *map(len, whole)])
        lo, hi, q = maximal(np.concatenate(whole))
        fine = hi - lo >= np.maximum(least, reps * q)
        lo, hi, q = lo[fine], hi[fine], q[fine]
        of = np.searchsorted(base, lo, side="right") - 1
        order = np.lexsort((q, lo))
        for k, s, e, p in zip(*(c[order].tolist() for c in (of, lo - base[of], hi - base[of], q)), strict=True):
            runs[deep[a + k]].append((s, e - s, p))
    return joined, runs


def collapse(joined: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if not runs:
        return joined
    words = joined.split(b" ")
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, reps: int = REPS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, runs in order of start and period, collapsed (UTF-8)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(np.array([len(t) for t in texts], np.int64), PART):
                joined, runs = runs_of(texts[lo:hi], least, reps)
                flat = [r for rs in runs for r in rs]
                columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(_RUN)))
                words = pa.array([j.count(b" ") + 1 if j else 0 for j in joined], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), words, lists, pa.array(map(collapse, joined, runs), pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def with_planted_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every text whose id's crc32 is divisible by 10 goes round in a cycle from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10).cast("long")

    def cycled(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("long")
        a, m = F.pmod(g, n), F.lit(3) + F.pmod(g, F.lit(8))
        p = F.lit(1) + F.floor((n - a) / m)
        cycle = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), m.cast("int")))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(cycle, F.lit(1), (n - a).cast("int")))

    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")
    text = F.element_at(F.transform(F.array(words), cycled), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, F.array_join(text, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_cycles(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    line = lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(F.lit(1000) * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
