"""Packing documents into training sequences by an order-preserving dynamic programme.

A window may end at the end of a document, at the end of a sentence or, failing those, anywhere. Over the boundaries of a stream
of documents f(i) = min over j of f(j) + padding(i - j) + penalty(i), the window i - j at most ``length`` tokens; as padding is
length - (P_i - P_j), the minimum over j is one of f(j) + P_j over a sliding window, which a monotone queue keeps in constant time.
Documents stay in the order in which Spark's partitions hold them; every partition packs its own rows, so nothing is shuffled and
padding is at most one tail for each partition. The tail goes into sequences whose lengths are powers of two, which need no padding.

A sequence id is unique (partition, number within it); all tokens of a document keep their order, each lies in exactly one piece.
Defined results: null and empty texts are one id (the end mark); null or repeated doc_ids are packed as rows of their own; an empty
table gives no pieces; other columns are ignored. Texts longer than a window are cut at sentences.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import SPACE, UNSURE, Cache, Texts, classes, gather, lay, odd_rows, parts, word_level

LENGTH, END_ID = 2048, 1
#: Tokens of padding that a cut inside a document, at a sentence or elsewhere, is worth.
SENTENCE_PENALTY, WORD_PENALTY = 2, 6
#: Inside longer sentences a cut may fall after every so many tokens.
STEP = 32
#: Boundaries are placed once a stream holds so many tokens: the programme's memory.
STREAM = 64 * LENGTH
CACHE = 400_000


@lru_cache(maxsize=1)
def _hard() -> np.ndarray:
    """Code points that the tokenizer's normal form may change otherwise than by one lower-case letter each: texts with one go to it whole."""
    out = np.ones(0x110000, bool)
    for lo, hi in ((0, 0x300), (0x370, 0x483), (0x48A, 0x590), (0x2000, 0x2C00), (0x3000, 0x3097), (0x309B, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4)):
        out[lo:hi] = [len(chr(c).lower()) != 1 or not unicodedata.is_normalized("NFC", chr(c)) or unicodedata.combining(chr(c)) > 0 for c in range(lo, hi)]
    out[ord("Σ")] = True  # its lower case depends on its place
    return out | (classes() == UNSURE)


class WordTokenizer:
    """Ids of many texts at once, with the ends of their sentences; distinct words are looked up, each is learned once.

    New words go to the library together, apart by spaces, which it drops; a word's last id is one that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache = Cache(self.learn, CACHE)

    def learn(self, words: list[bytes]) -> list[bytes]:
        raw = np.array(self.library.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        stops = (np.flatnonzero(self.ends[raw]) + 1) * 4
        data = raw.tobytes()
        return [data[lo:hi] for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the sizes of its sentences; a text that goes to the library whole is one sentence."""
        odd = {i for a in self.added for i, x in enumerate(texts) if a in x} | set(odd_rows(lay(texts), _hard()).tolist())
        t = lay(["" if i in odd else x.lower() for i, x in enumerate(texts)])
        lo, hi = word_level(t)
        codes, words = t.words(lo, hi)
        n, begin, flat = self.cache.ids(words)
        ids, total = flat[gather(n, begin, codes)], np.concatenate([[0], np.cumsum(n[codes])])
        first = total[np.searchsorted(lo, t.rows)].tolist()
        cuts = total[self.sentence_ends(t, lo, hi)]
        held = np.searchsorted(cuts, first[1:], side="left").tolist()
        out, k = [], 0
        for i, (a, b, m) in enumerate(zip(first[:-1], first[1:], held, strict=True)):
            if i in odd:
                whole = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4")
                out.append((whole, np.array([len(whole)])))
            else:
                # an end at a text's end closes its last sentence all the same
                out.append((ids[a:b], np.diff(np.concatenate([[a], cuts[k:m], [b]]))))
            k = m + 1 if m < len(cuts) and cuts[m] == b else m
        return out

    @staticmethod
    def sentence_ends(t: Texts, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Numbers of the words after which a sentence ends: a stop before white space, or a line's end."""
        if not len(hi):
            return np.zeros(0, np.int64)
        after = np.append(t.points, 0)[hi]
        lines = np.concatenate([[0], np.cumsum(t.points == 10)])
        stop = np.isin(t.points[hi - 1], [ord(c) for c in ".!?|"]) & (np.append(classes()[t.points], 0)[hi] == SPACE)
        return np.flatnonzero(stop | (after == 10) | (lines[np.append(lo[1:], len(t.points))] > lines[hi])) + 1


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, kept between its tasks."""
    return WordTokenizer(path)


def choose_cuts(bounds: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Indices of the boundaries at which windows end, the last one included.

    bounds: increasing token offsets, bounds[0] = 0, gaps at most length. The queue's least f(j) + P_j gives
    f(i) = f(j) + P_j + length - P_i + penalty(i), so f(i) + P_i needs no P_i.
    """
    n = len(bounds)
    back = [0] * n
    values, nodes, head = [0], [0], 0  # the queue: f(j) + P_j and j from head on, values increasing
    p, pen = bounds.tolist(), penalty.tolist()
    for i in range(1, n):
        at = p[i]
        while p[nodes[head]] < at - length:
            head += 1
        back[i] = nodes[head]
        value = values[head] + pen[i]
        value += length
        while len(values) > head and values[-1] >= value:
            values.pop()
            nodes.pop()
        values.append(value)
        nodes.append(i)
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


def boundaries(sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, from 0 on, and their penalties, for documents given as sizes of their sentences."""
    last = np.cumsum([len(d) for d in sizes]) - 1
    each = np.concatenate(sizes).astype(np.int64)
    ends = np.cumsum(each)
    cost = np.full(len(each), SENTENCE_PENALTY)
    cost[last] = 0
    fine = each > 0
    fine[last] = True
    each, ends, cost = each[fine], ends[fine], cost[fine]
    more = np.maximum(each - 1, 0) // STEP
    inside = np.repeat(ends - each, more) + STEP * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    at = np.concatenate([[0], ends, inside])
    cost = np.concatenate([[0], cost, np.full(len(inside), WORD_PENALTY)])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    return at[first], cost[first]


def cut_stream(sizes: list[np.ndarray], length: int, final: bool) -> tuple[list[int], int]:
    """Window ends (token offsets) for documents given as sizes of their sentences (the last one ends the document).

    Unless final, the last windows are left open: only ends up to one window before the end are settled.
    """
    ends, pens = boundaries(sizes)
    cuts = ends[choose_cuts(ends, pens, length)]
    return cuts[cuts <= ends[-1] - length].tolist() if not final else cuts.tolist(), int(ends[-1])


def _tail(n: int, length: int) -> list[int]:
    """n as sizes that need no padding: full windows, then powers of two, largest first."""
    return [length] * (n // length) + [1 << b for b in range(n.bit_length() - 1, -1, -1) if (n % length) >> b & 1]


def pack_rows(rows: Iterator[tuple[int | None, np.ndarray, np.ndarray]], length: int = LENGTH, stream: int = STREAM) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids as bytes, doc_tokens, sequence number, offset) of one partition's documents (id, ids, sizes of sentences) in order."""
    held: list[tuple[int | None, np.ndarray, np.ndarray, int, int]] = []  # doc_id, ids left, sizes of sentences left, ids before, ids in all
    size, sequence = 0, 0

    def emit(windows: list[int]) -> Iterator[tuple]:
        nonlocal held, size, sequence
        k, used = 0, 0
        for w in windows:
            offset = 0
            while offset < w:
                doc_id, ids, _, before, total = held[k]
                take = min(w - offset, len(ids) - used)
                yield doc_id, before + used, ids[used : used + take].tobytes(), total, sequence, offset
                offset, used = offset + take, used + take
                if used == len(ids):
                    k, used = k + 1, 0
            sequence += 1
        size -= sum(windows)
        if used:
            doc_id, ids, sizes, before, total = held[k]
            ends = np.cumsum(sizes)
            gone = int(np.searchsorted(ends, used, side="right"))
            rest = sizes[gone:].copy()
            rest[0] = ends[gone] - used
            held[k] = (doc_id, ids[used:], rest, before + used, total)
        held = held[k:]

    for doc_id, ids, sizes in rows:
        held.append((doc_id, ids, sizes, 0, len(ids)))
        size += len(ids)
        if size >= stream:
            cuts, _ = cut_stream([h[2] for h in held], length, False)
            yield from emit(np.diff([0, *cuts]).tolist())
    if size:
        cuts, at = cut_stream([h[2] for h in held], length, True)
        windows = np.diff([0, *cuts]).tolist()
        yield from emit(windows[:-1] + _tail(windows[-1], length))


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents; ids holds a piece's own ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(tokenizer_path)
        end = np.array([END_ID], "<u4")
        first = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
            for b in batches:
                doc_ids, at = b.column(0).to_pylist(), 0
                for texts in parts(b.column(1)):
                    for i, (ids, sizes) in enumerate(t.encode(texts)):
                        sizes[-1] += 1
                        yield doc_ids[at + i], np.concatenate([ids, end]), sizes
                    at += len(texts)

        def flush(out: list[tuple]) -> pa.RecordBatch:
            ids, start, raw, total, seq, offset = zip(*out, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [long(ids), long(start), long([len(r) // 4 for r in raw]), long([zlib.crc32(r) for r in raw]), long(total), long([first + s for s in seq]), long(offset), pa.array(raw, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        out: list[tuple] = []
        for piece in pack_rows(rows(), length):
            out.append(piece)
            if len(out) >= 2000:
                yield flush(out)
                out = []
        if out:
            yield flush(out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA)


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _path()).drop("ids")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of the documents that are left."""
    return pack(docs, _path()).drop("ids")
