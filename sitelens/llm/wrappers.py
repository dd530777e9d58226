"""HTML extraction by union-free regular expressions inferred for each host.

Pages of a host are grouped by template shape (the set of their containers); all different pages of a shape are aligned into one
wrapper: adjacent equal blocks of tags become repeated groups, blocks that one side lacks become optional groups, texts that differ
become slots. Pages are aligned in buckets of about FAN, their expressions again FAN at a time until one is left, so no task holds a
shape's pages. What an optional group holds never becomes required again and is not kept: an expression is no longer than its shortest
page, but for the marks of such groups. The container that holds the text outside the wrapper's constants is the main text of every
page of the shape; an article or main element is taken before others where it holds most of that text. Inside it the blocks that the
wrapper has as constant text go too (headings stay), where LEAST different pages agree on them, so what is left are the slots; a page
of which they are more than one in CONSTANT keeps them. Weights are sums over all different pages. Every page is extracted whole.

Wrappers are broadcast while their measured size is below WRAPPER_BYTES, otherwise joined.

Defined results: null or empty html gives an empty text; a null or odd url is a host of its own name ''; broken markup (open
paragraphs, stray end tags) is tolerated; repeated rows give equal rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

FAN, WRAPPER_BYTES, LEAST, CONSTANT = 64, 16 << 20, 4, 5
# Element names by role.
HIDDEN = frozenset("script style noscript template svg head iframe object canvas".split())
FURNITURE = HIDDEN | frozenset("nav header footer aside form menu button select textarea dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What ends when another one opens, and the elements around it that keep it open.
ENDS = {"p": BLOCKS - {"p"}, "li": frozenset("ul ol menu".split())}
# Never furniture by a class, id or role.
HOLDERS = frozenset("html body main article".split())
_ROLE = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|header|footer|comments?|replies|disqus|cookies?|consent|notices?|newsletter|subscribe|share|social|related|popup|modal|login|search)(?:$|\s)",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S | re.I)
CONTAINERS = frozenset("body main article section div td".split())
SEP, UNIT = "\x1f", "\x1e"
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, furniture) in page order; kind is text, open or close; value a text or a name with its class; furniture is 2 by
    the element's name, 1 by a whole word of its class, id or role, else 0."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], 0
        at = m.end()
        name = (m[2] or "").lower()
        if name:
            if m[1]:
                yield "close", name, 0
            else:
                marks = [" ".join(x for x in a[1:] if x) for a in _ATTRIBUTE.findall(m[3])] if m[3] else []
                label = name + ("." + marks[0].strip() if marks else "")
                yield "open", label, 2 if name in FURNITURE else int(name not in HOLDERS and any(_ROLE.search(x) for x in marks))
    if at < len(page):
        yield "text", page[at:], 0


def walk(page: str) -> Iterator[tuple[str, tuple[str, ...], bool]]:
    """(text or '' at a block's edge, path of containers, furniture) in page order. An element that is furniture by a word only, but
    holds most of the text outside other furniture, is none."""
    out: list[tuple[str, tuple[str, ...], tuple[int, ...] | None]] = []  # texts with the marked elements around, None in named furniture
    stack: list[tuple[str, str, tuple[int, ...] | None]] = []
    path: tuple[str, ...] = ()
    opened = 0
    for kind, value, furniture in tokens(page):
        around = stack[-1][2] if stack else ()
        if kind == "text":
            if value:
                out.append((value, path, around))
            continue
        name = value.split(".", 1)[0]
        if name in BLOCKS:
            out.append(("", path, ()))
        elif name == "br":
            out.append((" ", path, around))
        if kind == "open" and name not in VOID:
            if name in ENDS:  # an open one ends, within its own list or block
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        around = stack[-1][2] if stack else ()
                        break
                    if stack[depth][0] in ENDS[name]:
                        break
            if name in HEADINGS and around is not None:  # an article's own heading is no page header
                around = tuple(x for x in around if x)
            if name == "header" and furniture == 2 and around is not None and any(s[0] == "article" for s in stack):
                furniture, around = 0, (*around, 0)
            opened += 1
            stack.append((name, value, None if furniture == 2 or around is None else (*around, opened) if furniture else around))
        elif kind == "close" and any(s[0] == name for s in stack):
            while stack.pop()[0] != name:
                pass
        path = tuple(s[1] for s in stack)
    held: dict[int, int] = {}
    total = 0
    for text, _, around in out:
        if around is not None and (n := len(text.strip())):
            total += n
            for x in around:
                held[x] = held.get(x, 0) + n
    # where an article or main element has text of its own, a longer advertisement stays one
    plain = any(around == () and text.strip() and any(x.split(".", 1)[0] in ("article", "main") for x in where) for text, where, around in out)
    most = set() if plain else {x for x, n in held.items() if 2 * n > total}
    for text, where, around in out:
        yield text, where, around is None or any(x not in most for x in around)


#: (path, text) of a piece of text without an edge of a block inside
Block = tuple[tuple[str, ...], str]


def _blocks(page: str) -> list[Block]:
    """(path, text) of the blocks outside furniture."""
    out: list[Block] = []
    held: list[str] = []
    where: tuple[str, ...] = ()

    def end() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((where, text))
        held.clear()

    for text, path, furniture in walk(page):
        if not text:
            end()
        elif not furniture:
            if not held or not "".join(held).strip():
                where = path
            held.append(text)
    end()
    return out


Item = tuple  # (kind, value, shape): kind tag (its path), text or same (a block's key; same is in all pages), slot, plus (items) or opt; equal shapes may stand for each other
SMALL = 1 << 12


class Shapes:
    """Numbers of shapes, so that blocks are compared by one integer however deep their groups are."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}

    def item(self, kind: str, value: object = None) -> Item:
        key = ("text",) if kind in ("text", "slot") else (kind, *(x[2] for x in value)) if kind == "plus" else (kind, value)
        return kind, value, self.known.setdefault(key, len(self.known))

    def fold(self, items: list[Item]) -> list[Item]:
        """Adjacent equal blocks (by shape, up to 8 items) as repeated groups; differing texts in them as slots."""
        out: list[Item] = []
        marks = [x[2] for x in items]
        i = 0
        while i < len(items):
            for size in range(1, 9):
                one, k = marks[i : i + size], 1
                if size > 1 or items[i][0] == "tag":
                    while marks[i + k * size : i + (k + 1) * size] == one:
                        k += 1
                if k > 1:
                    out.append(self.item("plus", tuple(self.item("slot") if x[0] == "text" else x for x in items[i : i + size])))
                    i += k * size
                    break
            else:
                out.append(items[i])
                i += 1
        return out

    def page_items(self, paths: list[str], keys: list[int], common: set[int] = frozenset()) -> list[Item]:
        """A page as tags (containers with their path, so blocks align only at the same place) and texts; blocks that all pages have in
        common join no repeated group."""
        items: list[Item] = []
        for path, key in zip(paths, keys, strict=True):
            items += [self.item("tag", path), self.item("same" if key in common else "text", key)]
        return self.fold(items)

    def align(self, wrapper: list[Item], other: list[Item]) -> list[Item]:
        """The union-free expression that covers both, each a page or an expression."""
        out: list[Item] = []
        i = k = 0
        shapes = [x[2] for x in wrapper], [-1 if x[0] == "opt" else x[2] for x in other]  # optional groups are no anchors
        for j, m, n in [*matching_runs(*shapes, {x[2] for x in wrapper if x[0] == "same"}), (len(wrapper), len(other), 0)]:
            if (i < j or k < m) and (not out or out[-1][0] != "opt"):
                out.append(self.item("opt"))
            out += [x if x[:2] == y[:2] or x[0] != "text" else self.item("slot") for x, y in zip(wrapper[j : j + n], other[m : m + n], strict=True)]
            i, k = j + n, m + n
        return out

    def align_all(self, expressions: Iterable[list[Item]]) -> list[Item]:
        return reduce(self.align, expressions)

    def load(self, text: str) -> list[Item]:
        def made(kind: str, value: object) -> Item:
            return self.item(kind, tuple(made(*x) for x in value) if kind == "plus" else value)

        return [made(*x) for x in json.loads(text)]


def dump(items: Iterable[Item]) -> str:
    def plain(x: Item) -> list:
        return [x[0], [plain(y) for y in x[1]] if x[0] == "plus" else x[1]]

    return json.dumps([plain(x) for x in items], separators=(",", ":"))


def constants(wrapper: list[Item]) -> list[int]:
    """The keys of the texts that are the same in all that the expression was made from."""
    return [x[1] for x in wrapper if x[0] in ("text", "same")]


def matching_runs(a: list[int], b: list[int], first: set[int] = frozenset()) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of runs of equal shapes, in order on both sides.

    The shapes in first divide before all others, so however many pages are aligned, those in one order everywhere stay together. Then
    common ends, then shapes that occur once on both sides and lie in the same order (the longest such chain) divide the rest. Where
    none are left, small stretches are compared in full, long ones by chaining the k-th occurrences of each shape: near linear in all."""
    pairs = _chain(a, 0, len(a), b, 0, len(b), False, first) if first else []
    todo = [(i + 1, j, k + 1, m, True) for (i, k), (j, m) in zip([(-1, -1), *pairs], [*pairs, (len(a), len(b))], strict=True)]
    while todo:
        lo, hi, low, high, fine = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            pairs.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            pairs.append((hi, high))
        if lo == hi or low == high:
            continue
        chain = _chain(a, lo, hi, b, low, high, True) if fine else []
        if not chain and (hi - lo) * (high - low) <= SMALL:
            for i, k, n in SequenceMatcher(None, a[lo:hi], b[low:high], autojunk=False).get_matching_blocks():
                pairs += [(lo + i + t, low + k + t) for t in range(n)]
            continue
        chain = chain or _chain(a, lo, hi, b, low, high, False)
        more = bool(chain) and fine
        pairs += chain
        for (i, k), (j, m) in zip([(lo - 1, low - 1), *chain], [*chain, (hi, high)], strict=True):
            if i + 1 < j and k + 1 < m and (more or (j - i) * (m - k) <= SMALL):
                todo.append((i + 1, j, k + 1, m, more))
    runs: list[tuple[int, int, int]] = []
    for i, k in sorted(pairs):
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == k:
            runs[-1] = (*runs[-1][:2], runs[-1][2] + 1)
        else:
            runs.append((i, k, 1))
    return runs


def _chain(a: list[int], lo: int, hi: int, b: list[int], low: int, high: int, once: bool, only: set[int] | None = None) -> list[tuple[int, int]]:
    """The longest rising chain of pairs of places: of shapes that occur once on each side, or of equal occurrences of any shape (in only)."""
    at: dict[int, list[int]] = {}
    for k in range(low, high):
        at.setdefault(b[k], []).append(k)
    count: dict[int, int] = {}
    for i in range(lo, hi):
        count[a[i]] = count.get(a[i], 0) + 1
    seen: dict[int, int] = {}
    found = []
    for i in range(lo, hi):
        if only is not None and a[i] not in only:
            continue
        n = seen[a[i]] = seen.get(a[i], 0) + 1
        places = at.get(a[i], ())
        if n <= len(places) and (not once or len(places) == count[a[i]] == 1):
            found.append((i, places[n - 1]))
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, k) in enumerate(found):
        t = bisect_left(tails, k)
        before.append(last[t - 1] if t else -1)
        if t == len(tails):
            tails.append(k)
            last.append(n)
        else:
            tails[t], last[t] = k, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(found[n])
        n = before[n]
    return out[::-1]


@lru_cache(maxsize=4096)
def _held(where: tuple[str, ...]) -> tuple[str, ...]:
    """The containers of a path; numbers in their labels are alike."""
    return tuple(re.sub(r"\d+", "0", x) for x in where if x.split(".", 1)[0] in CONTAINERS)


def shape(blocks: list[Block]) -> int:
    """The template shape of a page: a hash of the set of its containers."""
    found = sorted({SEP.join(_held(where)) for where in {where for where, _ in blocks}})
    return int.from_bytes(hashlib.blake2b("\n".join(found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _key(path: str, text: str) -> int:
    """64 bits that stand for a block: its place and text."""
    return int.from_bytes(hashlib.blake2b(SEP.join((path, text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=4096)
def _around(path: str) -> tuple[tuple[str, ...], bool]:
    """The containers around a block, the whole page ('') first, and whether it is a heading."""
    where = tuple(path.split(SEP)) if path else ()
    parts = _held(where)
    return tuple(SEP.join(parts[:n]) for n in range(len(parts) + 1)), bool(where) and where[-1].split(".", 1)[0] in HEADINGS


def weigh(paths: list[str], keys: list[int], sizes: list[int], constant: set[int]) -> dict[str, int]:
    """The text of each container of a page, of which constants count a hundredth."""
    out: dict[str, int] = {}
    for path, key, size in zip(paths, keys, sizes, strict=True):
        weight = size if key in constant else 100 * size
        for x in _around(path)[0]:
            out[x] = out.get(x, 0) + weight
    return out


def choose(sums: dict[str, int], constant: Iterable[tuple[str, int]], pages: int) -> str:
    """The wrapper as what extraction needs of it: the path of the main container ('' where there is none) and the keys of the constant
    blocks in it. sums: the weights of containers; constant: paths and keys."""
    total = sums.get("", 0)
    weight = {tuple(x.split(SEP)): w for x, w in sums.items() if x}
    for name in ("article", "main"):
        named = [p for p, w in weight.items() if p[-1].split(".", 1)[0] == name and 2 * w >= total]
        if named:
            path = SEP.join(min(named, key=lambda p: (len(p), p)))
            break
    else:
        # the deepest container that still holds nearly all slots
        path = SEP.join(max((p for p, w in weight.items() if 5 * w >= 4 * total), key=lambda p: (len(p), p), default=()))
    drop = {key for where, key in constant if path in _around(where)[0] and not _around(where)[1]} if pages >= LEAST else ()
    return UNIT.join([path, *map(str, sorted(drop))])


def infer(pages: list[str]) -> str:
    """The wrapper of these pages, made as `main_text` makes that of a shape, but in one place."""
    return infer_blocks([_blocks(p or "") for p in dict.fromkeys(pages)])


def infer_blocks(pages: list[list[Block]]) -> str:
    marked = list({tuple(m[1]): m for m in map(marks, pages)}.values())
    constant: set[int] = set()
    if len(marked) > 1:
        common = set.intersection(*(set(keys) for _, keys, _ in marked))
        shapes = Shapes()
        constant = set(constants(shapes.align_all(shapes.page_items(paths, keys, common) for paths, keys, _ in marked)))
    sums: Counter[str] = Counter()
    for m in marked:
        sums.update(weigh(*m, constant))
    return choose(sums, [x for x in zip(*marked[0][:2], strict=True) if x[1] in constant] if marked else [], len(marked))


def marks(blocks: list[Block]) -> tuple[list[str], list[int], list[int]]:
    """What inference needs of a page: paths, keys and sizes of its blocks."""
    paths = [SEP.join(where) for where, _ in blocks]
    return paths, [_key(path, text) for path, (_, text) in zip(paths, blocks, strict=True)], [len(text) for _, text in blocks]


def extract(page: str | None, wrapper: str) -> str:
    """The page's main text: the blocks in the wrapper's container without its constants; all blocks where the container is not there."""
    return extract_blocks(_blocks(page or ""), wrapper)


def extract_blocks(blocks: list[Block], wrapper: str) -> str:
    container, *constant = wrapper.split(UNIT)
    want, drop = tuple(container.split(SEP)) if container else (), set(constant)
    inside = [(where, t) for where, t in blocks if _held(where)[: len(want)] == want]
    inside = inside or blocks
    left = [t for where, t in inside if str(_key(SEP.join(where), t)) not in drop] if drop else []
    size = sum(len(t) for _, t in inside)
    # a page of mostly equal text loses nothing
    return "\n".join(left if CONSTANT * (size - sum(map(len, left))) <= size else [t for _, t in inside])


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def fit(rows: DataFrame) -> DataFrame:
    """One row per host and shape: host, shape, container (as `choose` returns it), from all rows of blocks."""
    # equal pages count once; copies combine before the shuffle
    pages = materialize(rows.groupBy("host", "shape", "p1", "p2").agg(*(F.first(c).alias(c) for c in ("paths", "keys", "sizes"))), "pages")
    heads = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(F.struct("p1", "p2", "paths", "keys")).alias("m"))
    heads = materialize(heads.select("host", "shape", "n", *(F.when(F.col("n") > 1, F.col("m")[c]).alias(c) for c in ("paths", "keys"))), "heads")
    shared = heads.where("n > 1").select("host", "shape", "n", F.col("keys").alias("head"))
    most, size = shared.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.length("host") + 32 + 8 * F.size("head")), F.lit(0))).first()
    near = F.broadcast if size <= WRAPPER_BYTES else lambda df: df

    # a block of all pages is in the head too
    found = pages.join(near(shared), ["host", "shape"]).select("host", "shape", "n", F.explode(F.array_intersect("keys", "head")).alias("key"))
    found = found.groupBy("host", "shape", "key").agg(F.count("*").alias("held"), F.first("n").alias("n")).where("held = n")
    common = shared.select("host", "shape", "n").join(found.groupBy("host", "shape").agg(F.collect_list("key").alias("common")), ["host", "shape"], "left")
    common = materialize(common, "common")

    def align(g: pd.DataFrame) -> pd.DataFrame:
        shapes, same = Shapes(), set() if g["common"].iloc[0] is None else set(g["common"].iloc[0].tolist())
        g = g.sort_values(["p1", "p2"])
        made = shapes.align_all(shapes.page_items(list(p), k.tolist(), same) for p, k in zip(g["paths"], g["keys"], strict=True))
        return pd.DataFrame({"host": [g["host"].iloc[0]], "shape": [g["shape"].iloc[0]], "part": [g["part"].iloc[0]], "expression": [dump(made)]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        shapes = Shapes()
        made = dump(shapes.align_all(map(shapes.load, g.sort_values("part")["expression"])))
        return pd.DataFrame({"host": [g["host"].iloc[0]], "shape": [g["shape"].iloc[0]], "part": [g["to"].iloc[0]], "expression": [made]})

    schema = "host string, shape long, part long, expression string"
    parts = pages.drop("sizes").join(near(common), ["host", "shape"]).withColumn("part", F.pmod("p1", F.ceil(F.col("n") / FAN)))
    parts = parts.groupBy("host", "shape", "part").applyInPandas(align, schema)
    most = -(-most // FAN)
    while most > 1:
        most = -(-most // FAN)
        parts = parts.withColumn("to", F.expr(f"part div {FAN}")).groupBy("host", "shape", "to").applyInPandas(merge, schema)

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [constants(Shapes().load(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], ["host", "shape", "constant"])

    fixes = materialize(parts.select("host", "shape", "expression").mapInArrow(fixed, "host string, shape long, constant array<long>").where("size(constant) > 0"), "constants")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: Counter[tuple[str, int, str]] = Counter()
            for host, shape, paths, keys, sizes, constant in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                for x, weight in weigh(paths, keys, sizes, set(constant or ())).items():
                    sums[host, shape, x] += weight
            made = [(*k, v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["host", "shape", "held", "weight"])

    sums = pages.join(near(fixes), ["host", "shape"], "left").select("host", "shape", "paths", "keys", "sizes", "constant")
    sums = sums.mapInArrow(weights, "host string, shape long, held string, weight long")
    sums = sums.groupBy("host", "shape", "held").agg(F.sum("weight").alias("weight"))
    # as many as a page has containers
    sums = sums.groupBy("host", "shape").agg(F.collect_list("held").alias("held"), F.collect_list("weight").alias("weight"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for held, weight, n, paths, keys, constant in zip(*(b.column(k).to_pylist() for k in range(2, 8)), strict=True):
                same = set(constant or ())
                made.append(choose(dict(zip(held, weight, strict=True)), [x for x in zip(paths, keys, strict=True) if x[1] in same] if same else [], n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["host", "shape", "container"])

    joined = sums.join(heads, ["host", "shape"]).join(fixes, ["host", "shape"], "left").select("host", "shape", "held", "weight", "n", "paths", "keys", "constant")
    return joined.mapInArrow(pick, "host string, shape long, container string")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host(F.col("url")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [_blocks(h) for h in b.column(2).to_pylist()]
            paths, keys, sizes = zip(*map(marks, pages), strict=True) if pages else ((), (), ())
            same = [hashlib.blake2b(array("q", k).tobytes(), digest_size=16).digest() for k in keys]
            made = [pa.array([int.from_bytes(x[at : at + 8], "big", signed=True) for x in same], pa.int64()) for at in (0, 8)]
            made += [pa.array(paths, pa.list_(pa.string())), pa.array([[text for _, text in p] for p in pages], pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(map(shape, pages), pa.int64()), *made], ["page_id", "url", "host", "shape", "p1", "p2", "paths", "texts", "keys", "sizes"])

    # each page is parsed once; what follows reads its blocks
    rows = materialize(rows.mapInArrow(parse, "page_id long, url string, host string, shape long, p1 long, p2 long, paths array<string>, texts array<string>, keys array<long>, sizes array<long>"), "blocks")
    wrappers = materialize(fit(rows), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("container") + 24), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(wrappers) if size <= WRAPPER_BYTES else wrappers, ["host", "shape"], "left").select("page_id", "url", "paths", "texts", F.coalesce("container", F.lit("")).alias("container"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract_blocks(_read(p, t), c) for p, t, c in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")


def _read(paths: list[str], texts: list[str]) -> list[Block]:
    known = {p: tuple(p.split(SEP)) if p else () for p in set(paths)}
    return [(known[p], t) for p, t in zip(paths, texts, strict=True)]


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
