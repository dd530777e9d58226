"""Exact removal of repeated byte strings of at least ``length`` bytes (suffix-array dedup by deep-shallow sorting).

Each window of ``length`` bytes selects an anchor, the leftmost smallest hash of its GRAM-byte strings, so equal windows select equal
anchors. An anchor's context is the text of all windows that select it. Anchors meet by hash in one shuffle, their bytes stay behind:
a context that occurs twice (equal anchor and context hashes, 128 bits) is repeated as a whole. Only contexts that differ from another one at
their anchor are fetched, with one of each repeated kind, and their windows, suffixes of the texts, are sorted within the
anchor's group: first by SHALLOW bytes (multikey steps over 8-byte words), then what still ties goes through blind tries: a group is
split by the length of the prefix that members share with its head and the byte after it, until prefixes reach ``length``.

A group of over ``big`` contexts never meets in one task. It is split by a further level: its windows fall into slices by their distance
from the anchor, and contexts meet again where a slice's common bytes are equal; slices grow narrower until groups are small (and
sorted) or a slice is one window, where the common bytes are the whole string. Copies in one Arrow batch count before the
shuffle, so a hot text or passage sends one row a batch.

Defined results: null text is empty; texts under ``length`` bytes are kept whole; repeated rows make each other's strings repeated and get
equal results; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import groups

LENGTH, GRAM, SHALLOW, BIG, CHUNK, CARRY = 200, 32, 16, 4096, 1 << 20, 1 << 17
_M = 0xD1342543DE82EF95
_INV = pow(_M, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M)))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^i and M^-i up to n, kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _M, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def _window_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each span values in a row: prefix minima and suffix minima of blocks of span values."""
    n = len(x) - span + 1
    blocks = np.full((-(-len(x) // span), span), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[: len(x)] = x
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor's place, anchor hash, context hash) of the texts laid end to end in raw; ends are their ends.

    Windows never cross texts. Long buffers are read in parts, each beginning with the last context of the one before.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    last, span, begin = len(raw) - length, length - GRAM + 1, 0
    whole = np.zeros(len(raw) + 1, bool)  # a window that starts here holds a text's end inside
    for e in ends[:-1].tolist():
        whole[max(e - length + 1, 0) : e] = True
    while begin <= last:
        stop = min(begin + CHUNK, last + 1)
        piece = raw[begin : stop + length - 1]
        up, down = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=sums[1:])
        n = len(piece) - GRAM + 1
        h = _mix((sums[GRAM:] - sums[:n]) * down[:n])
        # ties go to the leftmost: the low half is the place
        best = _window_min((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), span)
        at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fine = ~whole[begin:stop]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        new[1:] |= fine[1:] != fine[:-1]
        lo = np.flatnonzero(new)
        hi = np.concatenate([lo[1:], [len(at)]]) - 1
        more = stop <= last
        if more:
            begin, lo, hi = begin + int(lo[-1]), lo[:-1], hi[:-1]
        keep = fine[lo]
        lo, hi = lo[keep], hi[keep]
        where = at[lo]
        context = _mix(_mix((sums[hi + length] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)) + (where - lo).astype(np.uint64) * np.uint64(_M))
        shift = begin - int(np.flatnonzero(new)[-1]) if more else begin
        parts.append((lo + shift, hi + shift, where + shift, h[where], context))
        if not more:
            break
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))


def repeated(buffer: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Flags of the suffixes whose first length bytes equal another's of the same group (deep-shallow)."""
    flag = np.zeros(len(starts), bool)
    live, part = np.arange(len(starts)), group
    for depth in range(0, SHALLOW, 8):  # shallow: multikey steps
        word = buffer[starts[live, None] + depth + np.arange(8)].view(">u8").ravel().astype(np.uint64)
        live, part = _split(live, part, [word])
    while len(live):  # deep: blind tries below each tied group
        head = np.concatenate([[True], part[1:] != part[:-1]])
        first = live[head][np.cumsum(head) - 1]
        shared = np.empty(len(live), np.int64)
        for i in range(0, len(live), 1 << 13):
            j = slice(i, i + (1 << 13))
            differ = buffer[starts[live[j], None] + np.arange(length)] != buffer[starts[first[j], None] + np.arange(length)]
            shared[j] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        same = (shared == length) & ~head
        flag[live[same]] = flag[first[same]] = True
        rest = shared < length
        live, part, shared = live[rest], part[rest], shared[rest]
        live, part = _split(live, part, [buffer[starts[live] + shared], shared])
    return flag


def _split(live: np.ndarray, part: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members in order of (part, keys), renumbered parts; members alone in theirs go."""
    if not len(live):
        return live, part
    order = np.lexsort([*keys, part])
    live, cols = live[order], [k[order] for k in (*keys, part)]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1
    return live[many], number[many]


def _batch(columns: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_LONG, _INT, _RAW = pa.int64(), pa.int32(), pa.binary()
#: A place: its text (hash and bytes), first window, last window, the anchor's distance from the first.
_FOUND = [("key", _LONG), ("context", _LONG), ("twice", pa.bool_()), ("own", pa.bool_()), ("k1", _LONG), ("size", _INT), ("lo", _INT), ("hi", _INT), ("at", _INT)]
_SPAN = [("k1", _LONG), ("size", _INT), ("lo", _INT), ("hi", _INT)]
_SHIPPED = [("key", _LONG), ("k1", _LONG), ("size", _INT), ("lo", _INT), ("at", _INT), ("bytes", _RAW)]


def _ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    names = {_LONG: "long", _INT: "int", _RAW: "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{n} {names[t]}" for n, t in schema)


def _find(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, raw) to their anchors. A context that a batch holds twice is settled there (own: its span is repeated) and only one
    of it goes on as a kind, marked twice."""
    for b in batches:
        k1 = b.column(0).to_numpy()
        raws = b.column(1).to_pylist()
        texts = {(k, len(r)): r for k, r in zip(k1.tolist(), raws, strict=True) if len(r) >= length}
        held, size, found = [], 0, []

        def flush() -> None:
            ends = np.cumsum([len(texts[t]) for t in held])
            lo, hi, at, key, context = anchors(np.frombuffer(b"".join(texts[t] for t in held), np.uint8), ends, length)
            of = np.searchsorted(ends, lo, side="right")
            base = (ends - [t[1] for t in held])[of]
            mine = np.array(held, np.int64)[of].reshape(-1, 2)
            found.append((key.view(np.int64), context.view(np.int64), mine[:, 0], mine[:, 1], lo - base, hi - base, at - lo))  # noqa: B023

        for t in texts:
            held.append(t)
            size += t[1]
            if size >= CHUNK:
                flush()
                held, size = [], 0
        if held:
            flush()
        if not found:
            continue
        key, context, text, total, lo, hi, at = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((context, key))
        key, context, text, total, lo, hi, at = (c[order] for c in (key, context, text, total, lo, hi, at))
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])])
        kind = np.cumsum(head) - 1
        twice = np.bincount(kind)[kind] > 1
        yield _batch([key, context, twice, twice & ~head, text, total, lo, hi, at], _FOUND)


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Kinds in order of (key, context) to places: those of repeated contexts (span: all their bytes), and one of each kind where
    its anchor has several (asked). The last anchor of a batch waits for the next; of a hot one only a kind's head waits."""
    names = ["key", "context", "twice", "k1", "size", "lo", "hi", "at"]
    rest: dict[str, np.ndarray] | None = None
    several = False

    def decide(t: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
        nonlocal several
        key, context = t["key"], t["context"]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        head = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        kind, anchor = np.cumsum(head) - 1, np.cumsum(new_key) - 1
        span = t["twice"] | (np.bincount(kind)[kind] > 1)
        many = np.bincount(anchor, head)[anchor] > 1
        if several:  # the first anchor had a kind before these
            many |= anchor == 0
        asked = many & head
        if "done" in t:
            asked &= ~t["done"]
        several = bool(not last and many[-1])
        out = span | asked
        return _batch([key[out], t["k1"][out], t["size"][out], t["lo"][out], t["hi"][out] + length, t["at"][out], span[out], asked[out]], _PLACE)

    for b in batches:
        t = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        if not len(t["key"]):
            continue
        t["done"] = np.zeros(len(t["key"]), bool)
        if rest is not None:
            t = {n: np.concatenate([rest[n], t[n]]) for n in t}
        first = int(np.searchsorted(t["key"], t["key"][-1]))
        if first:
            yield decide({n: c[:first] for n, c in t.items()}, True)
        rest = {n: c[first:] for n, c in t.items()}
        if len(rest["key"]) > CARRY:
            yield decide(rest, False)
            asked_head = rest["context"] == rest["context"][-1]
            one = int(np.flatnonzero(asked_head)[0])
            rest = {n: c[one : one + 1].copy() for n, c in rest.items()}
            rest["done"][:] = several
            rest["twice"][:] |= asked_head.sum() > 1
    if rest is not None:
        yield decide(rest, True)


_PLACE = [("key", _LONG), ("k1", _LONG), ("size", _INT), ("lo", _INT), ("hi", _INT), ("at", _INT), ("span", pa.bool_()), ("asked", pa.bool_())]


def _sort(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of shipped contexts to the spans of windows that another context of the group holds too."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        rows, held, size = held, [], 0
        buffer = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        wide = np.array([len(r[5]) for r in rows])
        base, windows = np.cumsum(wide) - wide, wide - length + 1
        of = np.repeat(np.arange(len(rows)), windows)
        first = np.cumsum(windows) - windows
        inside = np.arange(len(of)) - first[of]
        _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        flags = repeated(buffer, base[of] + inside, group[of].astype(np.int64), length)
        # runs of flagged windows of one context
        edge = np.concatenate([[False], flags, [False]])
        starts_here = flags & ~(edge[:-2] & (inside > 0))
        ends_here = flags & ~(edge[2:] & np.concatenate([inside[1:] > 0, [False]]))
        a, z = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
        at = of[a]
        k1, total, lo = (np.array([r[c] for r in rows], np.int64)[at] for c in (1, 2, 3))
        return _batch([k1, total, lo + inside[a], lo + inside[z] + length], _SPAN)

    for (key,), parts in groups(batches, 1):
        seen: set[tuple] = set()
        for p in parts:
            for r in zip(*(p.column(c).to_pylist() for c in ("k1", "size", "lo", "at", "bytes")), strict=True):
                if r[:3] not in seen:  # a place may be shipped from several copies of its text
                    seen.add(r[:3])
                    held.append((key, *r[:3], None, r[4]))
                    size += len(r[4])
        if size > CHUNK:
            yield flush()
    if held:
        yield flush()


def _narrow(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Shipped contexts to slices of at most width windows, keyed by the bytes that all windows of the slice hold."""
    for b in batches:
        out: list[tuple] = []
        for _, k1, size, lo, at, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ahead, last = at, len(raw) - length  # windows 0..last start ahead bytes before the anchor and nearer
            for s in range((ahead - last) // width, ahead // width + 1):  # distances s * width .. s * width + width - 1
                near, far = ahead - s * width, ahead - s * width - width + 1
                i, j = max(far, 0), min(near, last)
                if i <= j:
                    core = raw[near : far + length]
                    key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=b"%d.%d" % (width, s)).digest(), "big", signed=True)
                    out.append((key, k1, size, lo + i, at - i, raw[i : j + length]))
            if len(out) > 20_000:
                yield _batch(list(zip(*out, strict=True)), _SHIPPED)
                out = []
        if out:
            yield _batch(list(zip(*out, strict=True)), _SHIPPED)


def _by_key(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *order)


def repeated_spans(docs: DataFrame, length: int = LENGTH, big: int = BIG) -> DataFrame:
    """Byte spans (k1, size, lo, hi) that repeated strings cover in texts, which their hash and size in bytes name."""
    keyed = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")).select(F.xxhash64("raw").alias("k1"), "raw")
    copies = keyed.select("k1", F.octet_length("raw").alias("size")).where(F.col("size") >= length).groupBy("k1", "size").count().where("count > 1")
    found = keyed.where(F.octet_length("raw") >= length).mapInArrow(lambda it: _find(it, length), _ddl(_FOUND))
    # places settled in their batch are told apart after one shuffle, which all anchors take
    found = found.withColumn("key", F.when(F.col("own"), F.xxhash64("k1", "lo")).otherwise(F.col("key")))
    places = _by_key(found, "context").mapInArrow(lambda it: _unmixed(it, length), _ddl(_PLACE))
    places = materialize(places, "places")
    spans = places.where("span").select("k1", "size", "lo", "hi").unionByName(copies.select("k1", "size", F.lit(0).alias("lo"), F.col("size").alias("hi")))
    asked = places.where("asked").select("key", "k1", "size", "lo", "hi", "at")
    sizes = asked.groupBy("key").agg(F.count("*").alias("m"))
    most = sizes.agg(F.max("m")).first()[0] or 0
    wanted = asked.groupBy("k1", "size").agg(F.collect_list(F.struct("key", "lo", "hi", "at")).alias("places"))
    texts = keyed.withColumn("size", F.octet_length("raw")).join(wanted.hint("merge"), ["k1", "size"]).select("k1", "size", "raw", "places")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out: list[tuple] = []
            for k1, size, raw, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k1, size) != before:  # copies of a text follow each other
                    out += [(p["key"], k1, size, p["lo"], p["at"], raw[p["lo"] : p["hi"]]) for p in places]
                before = (k1, size)
                if len(out) > 20_000:
                    yield _batch(list(zip(*out, strict=True)), _SHIPPED)
                    out = []
            if out:
                yield _batch(list(zip(*out, strict=True)), _SHIPPED)

    shipped = texts.mapInArrow(ship, _ddl(_SHIPPED))
    results, width = [spans], length - GRAM + 1
    while most > big:  # split hot groups by a further level
        shipped = materialize(shipped, "shipped")
        sizes = materialize(shipped.groupBy("key").agg(F.count_distinct("k1", "size", "lo").alias("m")).where("m > 1"), "sizes")
        if width == 1:  # a group is one string
            results.append(shipped.join(sizes.where(F.col("m") > big).hint("merge"), "key").select("k1", "size", "lo", (F.col("lo") + length).alias("hi")))
        small = shipped.join(sizes.where(F.col("m") <= big).select("key").hint("merge"), "key", "left_semi")
        results.append(_by_key(small.select(*(n for n, _ in _SHIPPED))).mapInArrow(lambda it: _sort(it, length), _ddl(_SPAN)))
        if width == 1 or (sizes.agg(F.max("m")).first()[0] or 0) <= big:
            break
        width = max(1, width // 6)
        hot = shipped.join(sizes.where(F.col("m") > big).select("key").hint("merge"), "key", "left_semi").select(*(n for n, _ in _SHIPPED))
        shipped = hot.mapInArrow(lambda it, width=width: _narrow(it, width, length), _ddl(_SHIPPED))
    else:
        results.append(_by_key(shipped).mapInArrow(lambda it: _sort(it, length), _ddl(_SPAN)))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _unmixed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Places settled in their batch pass as spans; the others are settled here."""

    def others() -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("own").to_numpy(zero_copy_only=False)
            if own.any():
                t = b.filter(pa.array(own))
                n, yes = t.num_rows, np.ones(t.num_rows, bool)
                ready.append(_batch([*(t.column(c).to_numpy() for c in ("key", "k1", "size", "lo")), t.column("hi").to_numpy() + length, t.column("at").to_numpy(), yes, np.zeros(n, bool)], _PLACE))
                b = b.filter(pa.array(~own))
            yield b

    ready: list[pa.RecordBatch] = []
    for out in _settle(others(), length):
        yield from ready
        ready.clear()
        yield out
    yield from ready


def remove_repeats(docs: DataFrame, length: int = LENGTH, big: int = BIG) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    cover = repeated_spans(docs, length, big).groupBy("k1", "size").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs_of, left = [], []
            size = [len(r) for r in b.column(1).to_pylist()]
            for raw, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, at, runs, end = [], 0, 0, None
                for lo, hi in sorted((s["lo"], s["hi"]) for s in found or []):
                    if end is None or lo > end:
                        kept.append(raw[at:lo])
                        runs += 1
                    end = at = max(at, hi)
                kept.append(raw[at:])
                left.append(b"".join(kept))
                runs_of.append(runs)
            n = np.array(size, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n - [len(x) for x in left], _LONG), pa.array(runs_of, _LONG), pa.array(left, _RAW)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).select("doc_id", F.xxhash64("raw").alias("k1"), F.octet_length("raw").alias("size"), "raw")
    each = rows.join(cover, ["k1", "size"], "left").select("doc_id", "raw", "spans")
    return each.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
