import pytest

from sitelens.operators import matching


def test_greedy_matches_a_plain_pass(spark):
    rows = [(i, j, float((i * 37 + j * 91) % 53)) for i in range(12) for j in range(15) if (i + j) % 3] + [(0, None, 0.0), (None, 1, 0.0), (3, 2, None)]
    df = spark.createDataFrame(rows, "l long, r long, d double")
    left, right, want = set(), set(), set()
    for d, i, j in sorted((d, i, j) for i, j, d in rows if None not in (i, j, d)):
        if i not in left and j not in right:
            want.add((i, j))
            left.add(i)
            right.add(j)
    got = [(r.l, r.r) for r in matching.greedy_pairs(df, "l", "r", "d").collect()]
    assert sorted(got) == sorted(want)
    assert matching.greedy_pairs(df.where("l < 0"), "l", "r", "d").count() == 0


def test_crossings(spark):
    rows = [(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 4.0, 4.0, 0.0), (3, 10.0, 10.0, 11.0, 11.0), (4, -3.0, 1.0, 9.0, 1.5), (5, 4.0, 4.0, 8.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    for cell in (0.7, 3.0, 50.0):
        assert sorted((r.a, r.b) for r in matching.crossings(df, cell).collect()) == [(1, 2), (1, 4), (2, 4)]


def _plain(rows):
    left, right, want = set(), set(), set()
    for d, i, j in sorted((d, i, j) for i, j, d in rows):
        if i not in left and j not in right:
            want.add((i, j))
            left.add(i)
            right.add(j)
    return want


@pytest.mark.parametrize("at_once", [100_000, 700])
def test_ties_and_chains_end(spark, at_once):
    """All costs equal among 60 and 60, and a chain in which each pair waits for the one before it."""
    tie = [(i, j, 1.0) for i in range(60) for j in range(60)]
    chain = [p for k in range(5000) for p in ((1000 + k, 1000 + k, 2.0 * k), (1000 + k, 1001 + k, 2.0 * k + 1))]
    rows = tie + chain[: 10_000 if at_once > 1000 else 2000]
    got = matching.greedy_pairs(spark.createDataFrame(rows, "l long, r long, d double"), "l", "r", "d", at_once)
    assert sorted((x.l, x.r) for x in got.collect()) == sorted(_plain(rows))


def test_neighbours_that_share_all_rights_take_turns(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(80) for j in range(100)], "l long, r long")
    assert sorted((x.l, x.r) for x in matching.first_unused(pairs, "l", "r").collect()) == [(i, i) for i in range(80)]


@pytest.mark.parametrize("at_once", [100_000, 50])
def test_conflicts_in_chains_and_hubs(spark, at_once):
    n = 3000 if at_once > 1000 else 60
    conflicts = [(i, i + 1) for i in range(n)] + [(5000, 5001 + k) for k in range(200)] + [(6000 + i, 6000 + j) for i in range(12) for j in range(i)]
    ids = sorted({x for p in conflicts for x in p})
    kept = set()
    near = {}
    for a, b in conflicts:
        near.setdefault(max(a, b), []).append(min(a, b))
    for i in ids:
        if not any(e in kept for e in near.get(i, [])):
            kept.add(i)
    got = matching.kept_apart(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(conflicts, "a long, b long"), at_once)
    assert {x.id for x in got.collect()} == kept
