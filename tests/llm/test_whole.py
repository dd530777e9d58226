"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pytest

from sitelens.llm import forest, quality, secrets, wrappers


def test_neighbours_of_small_tables_are_whole(spark):
    for n in (12, 25, 100):
        v = np.random.default_rng(n).normal(size=(n, 64))
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        found = forest.search(df, df).toPandas()
        want = {(q, i) for q in range(n) for i in sorted((j for j in range(n) if j != q), key=lambda j: -(v[q] @ v[j]))[:20]}
        assert set(zip(found.query_id, found.vec_id, strict=True)) == want


def _best(v, q, k=20):
    score = (v * v[q]).sum(axis=1)
    return sorted((j for j in range(len(v)) if j != q), key=lambda j: (-score[j], j))[:k]


@pytest.mark.parametrize("kind", ["tiny", "huge", "mixed", "ties"])
def test_neighbours_by_exact_product(spark, kind):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1500, 24))
    v *= {"tiny": 1e-8, "huge": 1e9, "mixed": np.exp(1.5 * rng.normal(size=(1500, 1))), "ties": 1.0}[kind]
    if kind == "ties":
        v[100:160] = v[100]
        v[200:230] = v[200] * (1 + 1e-14 * np.arange(30))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = forest.search(df, df.where("vec_id % 20 = 0")).toPandas().sort_values(["query_id", "rank"])
    hit, total = 0, 0
    for q, g in found.groupby("query_id"):
        score = (v * v[q]).sum(axis=1)
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, score[g.vec_id], rtol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        hit, total = hit + len(set(g.vec_id) & set(_best(v, q))), total + 20
    assert hit >= 0.9 * total


@pytest.mark.parametrize("n", [3000, 12000])
def test_share_is_learned_from_how_vectors_lie(n):
    rng = np.random.default_rng(0)
    shares = []
    for clustered in (False, True):
        x = rng.normal(size=(n, 16)) * (0.1 if clustered else 1)
        x += clustered * rng.normal(size=(40, 16))[rng.integers(0, 40, n)]
        longest = float((x * x).sum(axis=1).max())
        rows, asked = forest.lift(x, 1.0, longest, False), forest.lift(x[:100], 1.0, longest, True)
        trees = [forest.grow(rows[:2000], 32, rng) for _ in range(forest.TREES)]
        share = forest.learn_share(trees, rows[:2000], asked, 20, forest.RECALL)
        leaf = [t.leaf_of(rows) for t in trees]
        got = 0
        for i, q in enumerate(asked):
            mine = np.zeros(n, bool)
            for t, node in forest.leaves_for(trees, q, share):
                mine |= leaf[t] == node
            got += mine[np.argsort(-(x @ x[i]))[1:21]].sum()
        assert got >= 0.9 * 2000
        shares.append(share)
    assert shares[1] < shares[0]


def test_secret_counts_of_base_values_and_owners(spark):
    key, copied, live = "0123456789abcdef" * 2, "fedcba98" * 4, "Ab3" * 10
    rows = [
        (1, f"a {key}", "acme/1"),
        (2, f"token={key}", "acme/2"),
        (3, f"a {copied} b", "acme/1"),
        (4, f"b {copied}", "other/2"),
        (5, f"use {live}", "acme/1"),
        (6, f"use {live}", "acme/2"),
        (7, None, None),
    ]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    held = {i: {(x.k, x.repositories, x.owners, x.live) for x in r.held} for i, r in got.items()}
    assert held[1] == {(2, 2, 1, True)} and held[2] == {(0, 2, 1, True), (2, 2, 1, True)}
    assert held[3] == held[4] == {(2, 2, 2, False)} and not held[7]
    # one owner's token in two of its repositories is not a copied example
    assert [len(got[i].added) for i in (5, 6)] == [1, 1] and held[5] == held[6] == {(3, 2, 1, True)}


def test_masks_rows_of_null_and_repeated_ids(spark):
    key = "0123456789abcdef" * 2
    rows = [(None, f"a {key}"), (None, f"bb {key} c"), (None, None), (1, f"a {key}"), (1, f"longer {key}"), (2, f"a {key}"), (2, "clean text of some length here, longer than the key")]
    rows = [(i, t, "en", "acme/1", 0) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = secrets.mask_secrets(spark, docs, "")
    want = [(i, t and t.replace(key, "<SECRET>")) for i, t, *_ in rows]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def _texts(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_class_words_do_not_empty_pages(spark):
    inner = "<p>a long enough text of the page</p><div class='sidebar'>links</div>"
    wraps = ["<body class='has-sidebar'>{}</body>", "<body class='search'>{}</body>", "<body><div id='main' class='with-sidebar'>{}</div></body>", "<body><article class='post has-share share'>{}</article></body>", "<body><div class='promo'>{}</div></body>"]
    pages = [(f"http://h{i}/", w.format(inner)) for i, w in enumerate(wraps)]
    assert _texts(spark, pages) == ["a long enough text of the page"] * 5
    ad = "<body><div class='ad'>an advertisement longer than the text</div><article><p>short</p></article></body>"
    assert _texts(spark, [("http://h/", ad)]) == ["short"]


def test_wrapper_decides_before_article(spark):
    text = "<p>{0} first paragraph, much longer than any teaser of the page</p><p>{0} second paragraph, as long as the one before it</p>"
    teasers = "<section><article>see {0}</article><article>and {0}</article></section>"
    main = "<body><main>" + text + "</main>" + teasers + "</body>"
    box = "<body><div class='text'>" + text + "</div>" + teasers + "</body>"
    # a host's second template, of which one long page has its text behind the first 262,144 characters
    late = "<body><div class='top'>all pages say this</div><!--" + "x" * (1 << 18) + "--><div class='body'>" + text + "</div></body>"
    words = ["alpha", "beta", "gamma"]
    pages = [(f"http://one/{w}", page.format(w)) for w in words for page in (main, box, late)]
    want = [f"{w} first paragraph, much longer than any teaser of the page\n{w} second paragraph, as long as the one before it" for w in words for _ in range(3)]
    assert _texts(spark, pages) == want


CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, base string, held string, live string, whole string, stats string, runs string, all string, _uid string"


def _clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "acme/1", 0, *["kept"] * 9) for i, t in rows], CLASH)


def _rows(df):
    got = df.collect()
    assert df.columns == [c.split()[0] for c in CLASH.split(", ")] and all(r[5:] == ("kept",) * 9 for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_stages_tell_rows_apart(spark):
    from sitelens.llm import jaccard, lines

    key = "0123456789abcdef" * 2
    rows = [(None, f"a {key}"), (None, f"bb {key} c"), (None, None), (1, f"longer {key}"), (1, "a perfectly clean text, that has no secrets in it at all"), (2, "Ab3" * 9)]
    want = [(i, t and t.replace(key, "<SECRET>").replace("Ab3" * 9, "<SECRET>")) for i, t in rows]
    assert _rows(secrets.mask_secrets(spark, _clashing(spark, rows), "")) == sorted(want, key=str)

    words = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(4)]
    rows = [(1, words[0]), (1, words[0]), (None, words[1]), (None, words[1]), (3, words[2]), (2, words[2] + " more"), (2, words[3]), (None, None), (None, "")]
    want = [(1, words[0]), (None, words[1]), (2, words[2] + " more"), (2, words[3]), (None, None), (None, "")]
    assert _rows(jaccard.keep_one(spark, _clashing(spark, rows), "")) == sorted(want, key=str)

    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(7))
    rows = [(1, f"first\n{run}"), (1, f"{run}\nlast"), (None, run), (None, None)]
    want = [(1, f"first\n{run}"), (1, "last"), (None, ""), (None, None)]
    assert _rows(lines.drop_lines(spark, _clashing(spark, rows), "")) == sorted(want, key=str)


def test_good_rows_stay_whatever_their_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = [(r.doc_id if k % 3 else None if k % 2 else 7, r.text) for k, r in enumerate(docs.orderBy("doc_id").limit(300).collect())]
    got = _rows(quality.keep_good(spark, _clashing(spark, [*some, (None, None)]), "/root/testdata/sf0.01"))
    texts = {t for _, t in got}
    # a text is kept or goes with all its rows
    assert 0 < len(got) < 301 and sorted(got, key=str) == sorted(((i, t) for i, t in [*some, (None, None)] if t in texts), key=str)


def test_line_runs_match_brute_force(spark):
    """Runs of random lines with repeated lines, blank lines and tails that only a later place shares."""
    from sitelens.llm import lines

    r = random.Random(6)
    pool = [" ".join(f"{k}y{j}" for j in range(r.choice((3, 9, 25, 40)))) for k in range(14)]
    docs = {i: "\n".join(r.choice(["", *pool]) if r.random() < 0.3 else pool[(i + k) % 14] for k in range(r.randint(0, 14))) for i in range(60)}
    got = {x.doc_id: x.text for x in lines.drop_repeated_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    places = [(d, [(p, x.strip()) for p, x in enumerate(t.split("\n")) if x.strip()]) for d, t in docs.items()]
    for n, (d, mine) in enumerate(places):
        gone = set()
        for e, other in places[: n + 1]:
            for i in range(len(mine)):
                for j in range(i if e == d else len(other)):
                    k = 0
                    while i + k < len(mine) and j + k < len(other) and mine[i + k][1] == other[j + k][1]:
                        k += 1
                    if sum(len(x.split()) for _, x in mine[i : i + k]) >= 50:
                        gone |= set(range(mine[i][0], mine[i + k - 1][0] + 1))
        assert got[d] == "\n".join(x for p, x in enumerate(docs[d].split("\n")) if p not in gone)


def test_broken_markup_and_lists(spark):
    nested = "<article><ul><li class='sidebar'><ul><li>away</li><li>away too</li></ul>still away</li><li>one<ul class='menu'><li>menu</li></ul></li><li>two<li>three</ul><p>text</p></article>"
    stray = "<body><div title=don't>it's <b class=x'y>all</b> here</div></body>"
    headed = "<body><header>page</header><article><header><h1>Title</h1><p>by line</p></header><p>text of it</p></article></body>"
    pages = [(f"http://n{k}/", p) for k, p in enumerate((nested, stray, headed))]
    assert _texts(spark, pages) == ["one\ntwo\nthree\ntext", "it's all here", "Title\ntext of it"]


def test_slots_are_what_differs():
    """Constant blocks go, as a plain reading without wrapper would keep them; equal pages and pages of mostly equal text lose nothing."""
    page = "<body><div class='top'>menu of all</div><div class='body'><h2>Part</h2><p>{0} is the first text of this page and long enough, as texts of pages are, for what all pages say to be little</p><p>Read more at our house</p><p>{0} ends</p></div></body>"
    pages = [page.format(w) for w in ("alpha", "beta", "gamma", "delta", "eps")]
    made = wrappers.infer(pages)
    want = "Part\n{0} is the first text of this page and long enough, as texts of pages are, for what all pages say to be little\n{0} ends"
    for w in ("alpha", "zeta"):
        assert wrappers.extract(page.format(w), made) == want.format(w) != wrappers.extract(page.format(w), "")
    same = wrappers.infer([pages[0]] * 6)
    assert "Read more at our house" in wrappers.extract(pages[0], same)
    short = "<body><div class='body'><p>a long text that all pages of this host have in common</p><p>{0}</p></div></body>"
    assert "in common" in wrappers.extract(short.format(1), wrappers.infer([short.format(k) for k in range(6)]))


def test_near_vectors_of_all_lengths_and_repeated_ids(spark):
    """Planted pairs near and at the threshold, vectors of rarer lengths, one vec_id with two vectors, ties, columns that clash."""
    from sitelens.llm import pivot_index

    rng = np.random.default_rng(11)
    v = [x for x in rng.normal(size=(700, 32))]
    for k in range(200):  # cosines from 0.9 up
        u = rng.normal(size=32)
        u -= (u @ v[k]) / (v[k] @ v[k]) * v[k]
        c = 0.9005 + 0.0995 * k / 200
        v.append(c * v[k] / np.linalg.norm(v[k]) + np.sqrt(1 - c * c) * u / np.linalg.norm(u))
    v += [np.array([1.0, 2.0, 3.0]), np.array([2.0, 4.0, 6.0]), np.array([0.0, 0.0, 1.0]), v[0] * 2, v[0]]
    ids = [*range(len(v) - 1), 5]  # the last one shares an id with another vector
    rows = [(i, x.tolist(), "r", 1) for i, x in zip(ids, v, strict=True)] + [(None, v[0].tolist(), "r", 1), (9000, None, "r", 1)]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, n int"))
    got = got.collect()
    links = [sum(len(x) == len(y) and x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y) for j, y in enumerate(v) if j != i) for i, x in enumerate(v)]
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r.n_links)
    assert sum(sum(x) for x in found.values()) >= 0.98 * sum(links)
    want = {}
    for i, n in zip(ids, links, strict=True):
        want.setdefault(i, []).append(n)
    assert all(a <= b for i in want for a, b in zip(sorted(found[i]), sorted(want[i]), strict=True))
    assert sorted(found[5]) == sorted(want[5]) and found[900] == found[901] == [1] and found[902] == [0] and found[None] == found[9000] == [0]
    parts = {r.vec_id: r.component_id for r in got}
    assert parts[901] == parts[900] == 900 and parts[5] == parts[0] == parts[903] == 0 and parts[None] is None


def test_pipeline_leaves_one_table(spark):
    import corpus_pipeline
    from sitelens.llm import common

    before = common.written()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(common.written()) == len(before) + 1 and out.count() > 0 and out.columns[:3] == ["doc_id", "start", "length"]
