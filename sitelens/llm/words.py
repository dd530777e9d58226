"""Words of whole Arrow batches: texts laid end to end are cut by a tokenizer's pattern with array operations, equal words are coded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 4
#: Texts are cut together until they hold so many bytes; a longer one is cut alone.
PART = 2 << 20
_QUOTE = ord("'")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point; UNSURE ones (unassigned here) may be assigned in the library's version of Unicode."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    names = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out = np.array([UNSURE if n == "Cn" else kinds.get(n[0], OTHER) for n in names], np.uint8)
    out[[*range(9, 14), 0x85]] = SPACE
    return out


@dataclass
class Texts:
    """Rows laid end to end: UTF-8 bytes, code points, the byte where each code point starts (and the end), where each row starts (and the end)."""

    data: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    rows: np.ndarray

    def words(self, marks: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
        """Code of each word and the distinct words; words run from mark to mark, or to their ends."""
        if not len(marks):
            return np.zeros(0, np.int64), []
        if ends is None:
            cut = self.starts[np.append(marks, len(self.points))]
            found = pa.Array.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(self.data)])
        else:  # what lies between words is cut out
            lo, hi = self.starts[marks], self.starts[ends]
            inside = np.zeros(len(self.data) + 1, np.int8)
            inside[lo] += 1
            inside[hi] -= 1
            data = np.ascontiguousarray(self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
            cut = np.concatenate([[0], np.cumsum(hi - lo)])
            found = pa.Array.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
        coded = found.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def lay(texts: list[str]) -> Texts:
    joined = "".join(texts)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) == len(joined):
        points, starts = data, np.arange(len(data) + 1)
    else:
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return Texts(data, points, starts, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def odd_rows(t: Texts, odd: np.ndarray) -> np.ndarray:
    """Rows that hold a code point marked odd."""
    found = np.flatnonzero(odd[t.points])
    return np.unique(np.searchsorted(t.rows, found, side="right") - 1) if len(found) else found


def parts(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a string column in parts of about PART characters; nulls are empty."""
    held, size = [], 0
    for t in pc.fill_null(column, "").to_pylist():
        held.append(t)
        size += len(t)
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (and the end), class and whether a row starts there, of the runs of one class in one row."""
    kind = classes()[t.points]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(kind) + 1, bool)
    first[t.rows] = True
    new |= first[:-1]
    at = np.flatnonzero(new)
    return np.append(at, len(kind)), kind[at], first[at]


def contractions(t: Texts, at: np.ndarray, kind: np.ndarray, first: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters that begin with the rest of 's 't 're 've 'm 'll 'd after a lone quote run (where free), and the letters taken."""
    q = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] == LETTER) & ~first[1:] & free[:-1] & (np.diff(at)[:-1] == 1))
    q = q[t.points[at[q]] == _QUOTE]
    run = q + 1
    a = t.points[at[run]]
    b = t.points[np.minimum(at[run] + 1, len(t.points) - 1)]
    two = at[run + 1] - at[run] >= 2
    pair = two & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    take = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, np.where(pair, 2, 0))
    return run[take > 0], take[take > 0]


def byte_level(t: Texts) -> np.ndarray:
    """Starts of the words of the byte-level pattern: contractions, ` ?` with letters, numbers or others, white space that gives its last one away."""
    if not len(t.points):
        return np.zeros(0, np.int64)
    at, kind, first = runs(t)
    mark = np.zeros(len(t.points) + 1, bool)
    mark[at] = True
    # white space that something follows in the row
    s = np.flatnonzero((kind[:-1] == SPACE) & ~first[1:])
    end = at[s + 1]
    mark[end[at[s + 1] - at[s] >= 2] - 1] = True
    taken = s[t.points[end - 1] == 0x20] + 1
    mark[at[taken]] = False
    free = np.ones(len(kind), bool)
    free[taken] = False
    run, take = contractions(t, at, kind, first, free)
    mark[at[run]] = False
    mark[at[run] + take] = True
    return np.flatnonzero(mark[:-1])


def word_level(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the other pattern: contractions, letters, single numbers, others; white space is none."""
    if not len(t.points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, kind, first = runs(t)
    mark = np.zeros(len(t.points) + 1, bool)
    mark[at] = True
    inner = np.repeat(kind, np.diff(at))
    mark[:-1] |= inner == NUMBER
    run, take = contractions(t, at, kind, first, np.ones(len(kind), bool))
    mark[at[run]] = False
    mark[at[run] + take] = True
    marks = np.flatnonzero(mark)
    keep = inner[marks[:-1]] != SPACE
    return marks[:-1][keep], marks[1:][keep]


def gather(lengths: np.ndarray, begins: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of the items of the words in codes, one after the other, where word k holds lengths[k] items from begins[k]."""
    n = lengths[codes]
    ends = np.cumsum(n)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    start = begins[codes[some]]
    head = ends[some] - n[some]
    out[head[0]] = start[0]
    out[head[1:]] = start[1:] - (start[:-1] + n[some][:-1] - 1)
    return np.cumsum(out)


class Cache:
    """Ids of words, each learned once by a worker; at most limit words are held."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], limit: int):
        self.learn, self.limit, self.held = learn, limit, {}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids and first place of each word, and all ids in one array."""
        found = list(map(self.held.get, words))
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            if len(self.held) + len(new) > self.limit:
                self.held.clear()
            for i, raw in zip(new, self.learn([words[i] for i in new]), strict=True):
                found[i] = self.held[words[i]] = raw
        flat = np.frombuffer(b"".join(found), "<u4")
        n = np.array([len(f) for f in found], np.int64) // 4
        return n, np.cumsum(n) - n, flat
