"""Byte-level BPE through a minimal acyclic transducer of frequent words.

Spark counts the corpus's words (each batch counts its own before the shuffle); the words from a count on that at most LEXICON reach are
encoded once and compiled into an automaton whose states share suffixes. A word's number is the sum of the counts skipped on its path;
the number leads to its ids. The automaton is one file, which Spark hands to its executors and every worker maps read-only. Workers cut
whole Arrow batches into words with array operations and walk all distinct words of a part through the automaton at once; words
outside it are merged exactly by the tokenizer itself, each once while a bounded cache holds it.

Decoding gathers the bytes of each id from the vocabulary and reads them as UTF-8.

Defined results: null text is empty (no ids, hashes of an empty string); texts that hold a special token's string or code points
unassigned in this Python are encoded whole by the library; repeated rows give equal rows; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import mmap
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, table
from .words import UNSURE, Cache, byte_level, classes, gather, lay, odd_rows, parts

LEXICON, CACHE, LONGEST = 100_000, 400_000, 64


def compile_lexicon(words: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A minimal acyclic automaton of sorted distinct words: first edge of each state, edge labels, targets, words skipped by an edge, final flags."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, state), ...)), frozen
    path: list[list] = [[False, []]]

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            state = (final, tuple(edges))
            if state not in register:
                register[state] = len(states)
                states.append(state)
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], register[state])

    last = b""
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        freeze(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    states.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(states), np.int64)
    first, labels, targets, skipped = [0], bytearray(), [], []
    for i, (final, edges) in enumerate(states):
        count = int(final)
        for label, to in edges:
            labels.append(label)
            targets.append(to)
            skipped.append(count)
            count += int(below[to])
        below[i] = count
        first.append(len(labels))
    return np.array(first, np.int64), bytes(labels), np.array(targets, np.int64), np.array(skipped, np.int64), np.array([s[0] for s in states], np.int64)


class Lexicon:
    """The automaton with the ids of its words, mapped from its file."""

    NAMES = ("first", "targets", "skipped", "final", "starts", "ids", "labels")

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, np.int64, len(self.NAMES))
        at = sizes.nbytes
        for name, n in zip(self.NAMES, sizes.tolist(), strict=True):
            setattr(self, name, np.frombuffer(self.map, np.int64, n, at))
            at += 8 * n
        # edges lie in order of (state, label)
        self.edges = np.repeat(np.arange(len(self.final)), np.diff(self.first)) << 8 | self.labels

    @staticmethod
    def file(words: list[bytes], ids: list[list[int]]) -> bytes:
        first, labels, targets, skipped, final = compile_lexicon(words)
        starts = np.cumsum([0] + [len(x) for x in ids])
        flat = np.array([i for x in ids for i in x])
        parts = [np.asarray(a, np.int64) for a in (first, targets, skipped, final, starts, flat, np.frombuffer(labels, np.uint8))]
        return np.array([len(a) for a in parts], np.int64).tobytes() + b"".join(a.tobytes() for a in parts)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the automaton does not hold it; all words walk one byte at a time."""
        size = np.array([len(w) for w in words], np.int64)
        data, base = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, number = np.full(len(words), len(self.final) - 1), np.zeros(len(words), np.int64)
        walking, depth = np.arange(len(words)), 0
        while len(walking) and len(self.edges):
            walking = walking[size[walking] > depth]
            key = state[walking] << 8 | data[base[walking] + depth]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[edge] == key
            state[walking[~there]] = -1
            walking, edge = walking[there], edge[there]
            number[walking] += self.skipped[edge]
            state[walking] = self.targets[edge]
            depth += 1
        whole = (state >= 0) & (self.final[state] == 1)
        return np.where(whole, number, -1)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encode_words(path: str, words: list[bytes]) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in _library(path).encode_batch([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)]


def count_words(docs: DataFrame) -> DataFrame:
    """(w, n): the corpus's words with their counts over all documents; each batch sends its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in parts(b.column(0)):
                t = lay(texts)
                codes, words = t.words(byte_level(t))
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(codes, minlength=len(words)))], ["w", "n"])

    return docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, path: str, size: int = LEXICON) -> bytes:
    """The file of the automaton: the most frequent words (of at most LONGEST bytes), all those from a count on, at most size.

    The count is read off a histogram with a bounded number of bins, so the driver gets that and at most size words."""
    counts = count_words(docs).where(F.octet_length("w") <= LONGEST)
    counts = counts.select("w", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int").alias("bin")).where("bin > 0")
    counts = materialize(counts, "words")
    least, held = None, 0
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r.bin):
        held += r["count"]
        if held > size:
            break
        least = r.bin
    found = [] if least is None else counts.where(F.col("bin") >= least).select("w").collect()
    words = sorted(bytes(r.w) for r in found)
    return Lexicon.file(words, [np.frombuffer(x, "<u4").tolist() for x in _encode_words(path, words)])


def share_file(spark: SparkSession, raw: bytes, name: str) -> str:
    """Write raw to the shared folder and let Spark fetch it to each executor once; returns the name for SparkFiles."""
    name = f"{name}-{uuid.uuid4().hex}"
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(raw))
    out.close()
    sc.addFile(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return name


@lru_cache(maxsize=1)
def _cache(path: str) -> Cache:
    """Words outside the automaton: alike for all automata, so a worker keeps one."""
    return Cache(lambda words: _encode_words(path, words), CACHE)


@lru_cache(maxsize=1)
def _worker(path: str, name: str) -> tuple:
    """What a Python worker keeps between its tasks; an earlier query's automaton goes."""
    library = _library(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    # a byte-level piece spells its bytes with one printable character each
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = [b""] * (max(library.get_vocab().values()) + 1)
    for w, i in library.get_vocab().items():
        pieces[i] = w.encode() if w in added else bytes(spelled[c] for c in w)
    spellings = [b"%d," % i for i in range(len(pieces))]
    flat = [(np.array([len(x) for x in xs]), np.frombuffer(b"".join(xs), np.uint8)) for xs in (pieces, spellings)]
    tables = [(n, np.cumsum(n) - n, data) for n, data in flat]
    return library, added, Lexicon(SparkFiles.get(name)), _cache(path), tables


def encode(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids as comma-joined text, decoded bytes, and the hashes of both."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = share_file(spark, build(docs, path, size), "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, added, lexicon, cache, tables = _worker(path, name)
        unsure = classes() == UNSURE

        def ids_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """All ids of the texts, and where each text's begin (and the end)."""
            t = lay(texts)
            marks = byte_level(t)
            codes, words = t.words(marks)
            number = lexicon.numbers(words)
            new = np.flatnonzero(number < 0)
            n, begin, more = cache.ids([words[i] for i in new])
            count, start = lexicon.starts[number + 1] - lexicon.starts[number], lexicon.starts[number].copy()
            count[new], start[new] = n, begin + len(lexicon.ids)
            flat = np.concatenate([lexicon.ids, more.astype(np.int64)])[gather(count, start, codes)]
            total = np.concatenate([[0], np.cumsum(count[codes])])
            return flat, total[np.searchsorted(marks, t.rows)]

        for b in batches:
            at = 0
            for texts in parts(b.column(1)):
                odd = {i for a in added for i, x in enumerate(texts) if a in x} | set(odd_rows(lay(texts), unsure).tolist())
                flat, bound = ids_of(["" if i in odd else x for i, x in enumerate(texts)])
                raws = []
                for n, begin, data in tables:
                    raw = data[gather(n, begin, flat)].tobytes()
                    ends = np.concatenate([[0], np.cumsum(n[flat])])[bound].tolist()
                    raws.append([raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)])
                n_tokens = np.diff(bound)
                for i in odd:
                    ids = np.array(library.encode(texts[i], add_special_tokens=False).ids, np.int64)
                    n_tokens[i] = len(ids)
                    for k, (n, begin, data) in enumerate(tables):
                        raws[k][i] = data[gather(n, begin, ids)].tobytes()
                decoded = [x.decode("utf-8", "replace").encode() for x in raws[0]]
                ids = [x[:-1] for x in raws[1]]
                digest = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, decoded)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(n_tokens), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()), pa.array(digest[0]), pa.array(digest[1])],
                    ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
