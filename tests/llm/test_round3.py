import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import common, copies, pivot_index, runs, secrets, whitening, wrappers

DATA = "/root/testdata/sf0.001"


def _copies(rows):
    """Brute force: (doc_id, keep_id, group_size, text_sha256) of every row, and how many rows of a text stay."""
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return Counter((d, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), groups


@pytest.mark.parametrize("hot", [1, 1024])
@pytest.mark.parametrize("weak", [None, 3, 1])
def test_copies_match_brute_force(spark, weak, hot):
    r = random.Random(5)
    texts = ["", None, "a", "a ", "é", "x" * 300_000, *("".join(r.choices("ab", k=r.randint(1, 4))) for _ in range(60))]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(None, "a"), (None, "lone"), (7, "a"), (7, "a"), (900, "hot")] + [(1000 + i, "hot") for i in range(150)]
    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], "doc_id long, text string, key string, n long, row long")
    hash_of = F.xxhash64 if weak is None else (lambda t: F.xxhash64(F.length(t) % weak))  # texts of one key must be told apart
    got = copies.exact_copies(df, hash_of, capacity=4, hot=hot).collect()
    want, groups = _copies(rows)
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == want
    assert sum(x.kept for x in got) == len(groups)
    assert all(x.doc_id == x.keep_id for x in got if x.kept)


@pytest.mark.parametrize("capacity", [1, 4, 50, 10_000])
def test_directory_covers_every_key_once(spark, capacity):
    keys = spark.range(3000).select(F.when(F.col("id") % 5 == 0, F.xxhash64("id") % 1000 + (1 << 40)).otherwise(F.xxhash64("id")).alias("key")).distinct()
    cells, bits = copies.directory(keys, capacity, deepest=12)
    held = keys.withColumn("cell", F.shiftrightunsigned("key", 64 - bits)).join(cells, "cell").toPandas()
    assert len(held) == keys.count()
    for bucket, g in held.groupby("bucket"):
        depth = g.depth.iloc[0]
        assert g.depth.nunique() == 1 and {c >> (bits - depth) for c in g.cell} == {bucket >> (bits - depth)}
        assert len(g) <= capacity or depth == bits
        if depth:  # the bucket had to split: its parent would be over-full
            parent = held[held.cell // 2 ** (bits - depth + 1) == bucket // 2 ** (bits - depth + 1)]
            assert len(parent) > capacity


def test_copies_of_nothing(spark):
    assert copies.exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_query_is_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = Counter(duckdb.sql(copies.ORACLE).fetchall())
    assert Counter(tuple(r) for r in copies.op12_exact_dedup(spark, DATA).collect()) == want


def _runs(words, least, reps):
    """Brute force: stretches in which all words agree with those q later, q the smallest that gives the stretch."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            s = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            n = k - s + q
            if k > s and n >= 2 * q and (s, n) not in seen:
                seen.add((s, n))
                if n >= max(least, reps * q):
                    out.append((s, n, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _cyclic(r):
    k = r.choice([1, 2, 3, 8])
    words = [r.choice("abcdefgh"[:k]) for _ in range(r.randint(0, 60))]
    cycle = [r.choice("abcdé"[:k]) for _ in range(r.randint(1, 12))]
    return words + cycle * r.randint(0, 9) + cycle[: r.randint(0, len(cycle))] + words[: r.randint(0, 30)] + ["x"] * r.choice([0, 3, 30])


@pytest.mark.parametrize("least,reps", [(24, 3), (2, 2), (6, 2), (10, 4)])
def test_runs_match_brute_force(least, reps):
    r = random.Random(least)
    for _ in range(150):
        texts = [_cyclic(r) for _ in range(4)]
        joined, got = runs.runs_of([" \n".join(t).encode() for t in texts], least, reps)
        assert got == [_runs(t, least, reps) for t in texts]
        for t, j, g in zip(texts, joined, got, strict=True):
            gone = {i for s, n, q in g for i in range(s + q, s + n)}
            assert runs.collapse(j, g).decode().split() == [w for i, w in enumerate(t) if i not in gone]


def test_runs_of_long_texts():
    r = random.Random(2)
    words = [str(r.randint(0, 900)) for _ in range(30_000)]
    _, got = runs.runs_of([("x " * 200_000).encode(), " ".join(words * 4).encode(), " ".join(words).encode()])
    assert got == [[(0, 200_000, 1)], [(0, 120_000, 30_000)], []]


def test_run_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {x.doc_id: x for x in runs.op13_periodic_runs(spark, d).collect()}
    assert got.keys() == rows.keys()
    for doc, text in rows.items():
        w = [x.decode() for x in text.encode().split()]
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = _runs(w, 24, 3)
        x = got[doc]
        best = min(want, key=lambda t: (-t[1] / t[2], t[0], t[2]), default=(None,) * 3)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert (x.n_runs, x.start, x.length, x.period) == (len(want), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(y for i, y in enumerate(w) if i not in gone).encode()).hexdigest()


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 1, 2), (1, "", 1, 2), (None, "a " * 30, 1, 2), (1, "a\x0bb\x1c c" + " a" * 24, 1, 2), (1, "a\x0bb\x1c c" + " a" * 24, 1, 2)]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs long, raw long")).collect()
    assert sorted((x.n_words, [tuple(r) for r in x.runs], bytes(x.collapsed)) for x in got) == [(0, [], b""), (0, [], b""), (27, [(3, 24, 1)], b"a b\x1c c a"), (27, [(3, 24, 1)], b"a b\x1c c a"), (30, [(0, 30, 1)], b"a")]
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(nothing).count() == runs.with_planted_cycles(nothing).count() == 0


def _whitened(vectors, k):
    """Closed form: floor(256 c), distinct rows, eigenvectors of the covariance."""
    x = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_matches_the_closed_form(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 3
    v[5:40] = v[4]
    rows = [(i, x.tolist(), 1, 2) for i, x in enumerate(v)]
    odd = [(9000, None, 1, 2), (9001, [None, *[0.0] * 11], 1, 2), (9002, [float("nan")] * 12, 1, 2), (9003, [float("inf")] * 12, 1, 2), (9004, [1.0], 1, 2), (None, v[9].tolist(), 1, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, x long, n long")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 701 * 4 and got.vec_id.isna().sum() == 4
    n, deviation, z, share = _whitened(v, 4)
    assert (got.n == n).all() and got.identity_error.max() < 1e-10
    got = got[got.vec_id.notna()].sort_values(["component", "vec_id"])
    assert got.deviation.to_numpy().reshape(4, -1).tolist() == [deviation.tolist()] * 4
    found = got.whitened.to_numpy().reshape(4, -1).T
    assert np.abs(found * np.sign((found * z).sum(axis=0)) - z).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(4, -1)[:, 0], share, rtol=1e-10)


@pytest.mark.parametrize("vectors,components", [([[1.0, 2.0]] * 3, 0), ([[0.0], [1.0]], 1), ([[0.0, 0.0, 5.0], [1.0, 1.0, 5.0], [2.0, 2.0, 5.0]], 1), ([[], []], 0)])
def test_whitening_without_variance(spark, vectors, components):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert whitening.whiten(df).count() == components * len(vectors)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_deviations_of_any_size(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(df).collect()} == {None}


@pytest.mark.parametrize("d,k", [(1, 4), (5, 4), (64, 4), (150, 6)])
def test_eigenpairs_reach_double_precision(d, k):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(2000, d)) * np.linspace(1, 1.3, d)
    v = a.T @ a / len(a)
    e, u = whitening.leading_pairs(lambda c: v @ c, d, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.abs(e - want).max() < 1e-13 * want[0] and np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-13 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13


def test_equal_eigenvalues():
    v = np.diag([5.0] * 5 + [1.0, 1.0, 0.0, 0.0])
    e, u = whitening.leading_pairs(lambda c: v @ c, 9, 6)
    assert np.allclose(e, [5, 5, 5, 5, 5, 1]) and np.allclose(v @ u, u * e)


@pytest.mark.parametrize("offset", [0, 1, 2, 3])
def test_recall_off_centre(spark, offset):
    """Vectors around a mean of offset times their spread: natural pairs (most of them at offset 3) and planted ones."""
    rng = np.random.default_rng(offset)
    x = rng.normal(size=(1500, 64))
    x[:, 0] += 8 * offset
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    a, u = unit(x[:400]), rng.normal(size=(400, 64))
    u = unit(u - (u * a).sum(axis=1, keepdims=True) * a)
    c = 0.9 + 0.1 * rng.random((400, 1)) ** 2
    x = np.vstack([x, 3 * (c * a + np.sqrt(1 - c * c) * u)])
    got = pivot_index.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    n = unit(x)
    links = (n @ n.T >= 0.9).sum(axis=1) - 1
    found = got.toPandas().set_index("vec_id").n_links.sort_index().to_numpy()
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


@pytest.mark.parametrize("step", pivot_index.LADDER)
def test_every_step_counts_a_pair_once(spark, step):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 16))
    x = np.vstack([base + 0.1 * rng.normal(size=base.shape) for _ in range(6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = pivot_index.near_duplicates(df, step=step, block=16).toPandas().set_index("vec_id").n_links.sort_index().to_numpy()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (n @ n.T >= 0.9).sum(axis=1) - 1
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_runs_beside_each_other_keep_their_tables(spark, tmp_path):
    """A table written by another query while the pipeline runs, and a second run, are left alone."""
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline

    with ThreadPoolExecutor(3) as pool:
        runs_ = [pool.submit(corpus_pipeline.run, spark, DATA) for _ in range(2)]
        other = [pool.submit(common.materialize, spark.range(k), "other") for k in range(1, 4)]
        first, second = (sorted(map(tuple, r.result().select("doc_id", "start", "ids_crc32").collect())) for r in runs_)
        assert [o.result().count() for o in other] == [1, 2, 3] and first == second and first


def _page(blocks):
    return "<body><nav>menu</nav><div id='m'>" + "".join(blocks) + "</div></body>"


def test_long_pages_are_aligned_in_near_linear_time():
    import time

    r = random.Random(1)
    took = []
    for n in (1000, 8000):
        pages = [_page([f"<div class='{r.choice('abcdef')}'><p>{r.choice([f'same on page {k}', 'x%d' % r.randint(0, 9999)])}</p></div>" for _ in range(n + k)]) for k in range(6)]
        began = time.time()
        made = wrappers.infer(pages)
        took.append(time.time() - began)
        assert all(wrappers.extract(p, made).count("\n") == n + k - 1 for k, p in enumerate(pages))
    assert took[1] < 30 * took[0]


def test_alignments_are_common_subsequences():
    from difflib import SequenceMatcher

    r = random.Random(3)
    for trial in range(300):
        n = r.choice([3, 20, 150])
        a = [r.randint(0, r.choice([2, 10, 400])) for _ in range(r.randint(0, n))]
        b = [x for x in a if r.random() < 0.8] if r.random() < 0.5 else [r.randint(0, 9) for _ in range(r.randint(0, n))]
        b += [r.randint(0, 400) for _ in range(r.randint(0, 5))]
        found = wrappers.matching_runs(a, b)
        i = k = 0
        for x, y, m in found:
            assert x >= i and y >= k and m > 0 and a[x : x + m] == b[y : y + m]
            i, k = x + m, y + m
        if len(a) * len(b) <= wrappers.SMALL and trial % 2:
            best = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            assert sum(m for *_, m in found) >= 0.5 * best


def test_pages_with_repeats_and_clashes(spark):
    page = lambda w: f"<body><div class='top'>all of it</div><div class='b'><p>{w} is what this page says, at some length</p><p>and {w} ends it</p></div></body>"
    rows = [(k, f"http://h/{k}", page(w), "c", 1) for k, w in enumerate(["one", "two", "three", "four"])]
    rows += [rows[0], (None, None, "", "c", 1), (9, "http://h/9", None, "c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, shape int")
    got = wrappers.main_text(df).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter([*((k, f"{w} is what this page says, at some length\nand {w} ends it") for k, w in enumerate(["one", "two", "three", "four"])), (0, "one is what this page says, at some length\nand one ends it"), (None, ""), (9, "")])


def test_spans_of_a_very_long_text(spark):
    """Tens of thousands of matches in one text, short ones that fail among them, end soon and lie where a plain scan finds them."""
    import re
    import time

    text = "".join(f"é token = {'s' * (i % 9)}{i} {i:040x} " for i in range(20_000))
    began = time.time()
    got = secrets.scan(spark.createDataFrame([(1, text, "a/b"), (2, "none", "a/b"), (3, "", None), (4, None, "x")], "doc_id long, text string, source string"))
    found = {r.doc_id: sorted((x.s, x.k, x.e) for x in r.base) for r in got.select("doc_id", "base").collect()}
    took = time.time() - began
    assign = re.compile(secrets.ASSIGN.replace("(?i:", "(?ai:"))
    want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24]
    assert found == {1: sorted(want), 2: [], 3: [], 4: []} and took < 120


def test_wrappers_are_fitted_on_all_pages(spark):
    """200 pages a host, in buckets and rounds: a text that one page lacks is no constant, and a few long pages count for the main container."""
    r = random.Random(5)
    page = "<body><div class='a'><p>{0} is what this page says, at such a length that what all pages say is little</p>{1}<p>{0} ends</p></div><div class='b'><p>{2}</p></div></body>"
    rows, want = [], {}
    for h in range(8):
        odd = r.randrange(200) if h % 2 else -1
        long = set(r.sample(range(200), 4)) if h >= 4 else set()
        pages = [page.format(f"w{h} {k}", f"<p>{'Read less' if k == odd else 'Read more'} at our house</p>", f"side {k} " * (3000 if k in long else 1)) for k in range(200)]
        made = wrappers.infer(pages)
        for k, p in enumerate(pages):
            text = wrappers.extract(p, made)
            assert ("at our house" in text) == (h < 4 and h % 2 == 1) and (" ends" in text) == (h < 4)
            rows.append((h * 200 + k, f"http://h{h}/{k}", p))
            want[h * 200 + k] = text
    # copies change nothing
    rows += [(2000 + k, *rows[k % 7][1:]) for k in range(300)]
    want |= {2000 + k: want[k % 7] for k in range(300)}
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(want) and {x.page_id: x.text for x in got} == want


def test_a_short_page_decides_for_itself_only(spark):
    """Constants are dropped from all pages but those of which they would be more than a fifth."""
    page = "<body><div class='m'><p>{0}</p><p>Read more at our house</p></div></body>"
    texts = [f"{k} is what this page says, at such a length that what all of the pages say is little of it, as in most cases" for k in range(90)]
    texts[37] = "short 37"
    rows = [(k, f"http://h/{k}", page.format(t)) for k, t in enumerate(texts)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == {k: t + ("\nRead more at our house" if k == 37 else "") for k, t in enumerate(texts)}


def test_expressions_merge_in_any_order():
    """Expressions of parts cover what the pages do, keep what all of them have and are no longer than a page."""
    r = random.Random(7)
    fixed = [("div", k) for k in range(100, 105)]
    for _ in range(50):
        pages = []
        for _ in range(12):
            blocks = [(r.choice("pqr"), r.randrange(1000, 9999)) for _ in range(r.randint(0, 8))]
            for at, x in zip(sorted(r.choices(range(len(blocks) + 1), k=5), reverse=True), fixed[::-1], strict=True):
                blocks.insert(at, x)
            pages.append(blocks)
        shapes = wrappers.Shapes()
        made = [shapes.page_items([p for p, _ in b], [k for _, k in b], {k for _, k in fixed}) for b in pages]
        parts = [wrappers.dump(shapes.align_all(made[k : k + 4])) for k in (0, 4, 8)]
        for order in (parts, parts[::-1]):
            other = wrappers.Shapes()
            whole = other.align_all(map(other.load, order))
            assert wrappers.constants(whole) == [k for _, k in fixed]
            assert len(whole) <= 2 * min(map(len, made)) + 1 and wrappers.dump(other.load(wrappers.dump(whole))) == wrappers.dump(whole)
