"""Queries against their SQL where many more features fall to a site than in the given tables."""

import duckdb
import pytest

from sitelens.plans import registry


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Features of keys up to 900,000 around site 3, which alone is there."""
    d = tmp_path_factory.mktemp("crowded")
    near = "-9.5 + k * 15485863 % 1000000 / 1e6 BETWEEN -8.77 AND -8.71 AND 38 + k * 32452843 % 1000000 / 1e6 BETWEEN 38.17 AND 38.2"
    duckdb.sql(f"COPY (SELECT k AS o_orderkey FROM range(1, 900000) r(k) WHERE {near}) TO '{d}/orders.parquet'")
    duckdb.sql(f"COPY (SELECT 3::BIGINT AS s_suppkey, 'Supplier 3' AS s_name) TO '{d}/supplier.parquet'")
    return str(d)


def differing(spark, d, name):
    """Rows that only the query or only its SQL gives, and the number of rows."""
    c = duckdb.connect()
    for t in ("orders", "supplier"):
        c.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = c.sql(registry.ORACLES[name])
    rows = registry.QUERIES[name](spark, d).select(*want.columns).collect()
    got, want = {tuple(r) for r in rows}, set(want.fetchall())
    return got ^ want, len(rows)


def test_lines_of_a_crowded_site(spark, crowded):
    """Lines take holes in turn by the distance of both their ends to the pins."""
    apart, rows = differing(spark, crowded, "layer_fusion")
    assert not apart and rows > 100


def test_sites_in_one_place_are_met_once(spark):
    """Of sites alike in centre and box the smallest is chosen; their number does not multiply the rows that features meet."""
    from pyspark.sql import functions as F

    from sitelens.operators.spatial import assign_to_sites

    k = F.col("id")
    one = lambda c: F.when(k % 2 == 0, F.lit(c)).cast("double")
    sites = spark.range(5, 4005).select(k.alias("site"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), one(0.99).alias("west"), one(1.99).alias("south"), one(1.01).alias("east"), one(2.01).alias("north"))
    feats = spark.range(2000).select(k.alias("feat"), (k * 0.00003 + 0.98).alias("lon"), F.lit(2.005).alias("lat"))
    found = assign_to_sites(feats, sites)
    got = {(r.feat, r.site) for r in found.collect()}
    assert {s for f, s in got if 400 < f < 900} == {6} and {s for f, s in got if f < 300 or f > 1100} == {5}
    # the rows of every join: none holds a pair for each site
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Sort [feat" not in plan and "SortAggregate" not in plan


def test_tees_of_a_crowded_site(spark):
    """Thousands of tees within reach of each other are passed over in order, by whole keys and by pairs alike."""
    import random

    from sitelens.operators import matching

    r = random.Random(4)
    spot = lambda k, site: (site, k, r.uniform(0, 0.02), r.uniform(0, 0.02))
    given, mapped = ([spot(k, s) for s, n in ((1, 700), (2, 30)) for k in range(s * 1000, s * 1000 + n)] for _ in range(2))
    reach, want, used = 0.008, {}, set()
    for site, p, x, y in sorted(given, key=lambda t: t[1]):
        for at, q, u, v in sorted(mapped, key=lambda t: t[1]):
            if at == site and q not in used and (x - u) * (x - u) + (y - v) * (y - v) <= reach * reach:
                want[p] = q
                used.add(q)
                break
    a = spark.createDataFrame(given, "site long, point long, lon double, lat double")
    b = spark.createDataFrame(mapped, "site long, feat long, rlon double, rlat double")
    for at_once in (100_000, 100):
        assert {x.point: x.feat for x in matching.first_unused_near(a, b, reach, "site", "point", "feat", at_once).collect()} == want


def test_boxes_share_what_clipping_finds(spark):
    from pyspark.sql import functions as F

    from sitelens.functions import rings

    c = lambda k: F.rand(k) * 4
    df = spark.range(500).select(*[c(k).alias(f"c{k}") for k in range(4)]).cache()
    a, b = ((F.col(x), F.col(y), F.col(x) + 1.5, F.col(y) + 2.5) for x, y in (("c0", "c1"), ("c2", "c3")))
    apart = F.abs(rings.box_overlap(a, b) - rings.overlap(rings.box(*a), rings.box(*b)))
    some = df.select(apart.alias("apart"), rings.box_overlap(a, b).alias("both"))
    assert some.where("apart > 1e-9").isEmpty() and some.where("both > 0").count() > 50 and some.where("both = 0").count() > 50


def test_wide_shapes_are_not_broadcast(spark):
    """A few wide shapes fill thousands of cells each, which no size of their table tells."""
    from pyspark.sql import functions as F

    from sitelens.functions import rings
    from sitelens.operators.refinement import meeting

    at = lambda half: rings.box(F.lit(1 - half), F.lit(1 - half), F.lit(1 + half), F.lit(1 + half)).alias("shape")
    a, b = (spark.range(n).select(F.lit(1).alias("site"), F.col("id"), at(half)) for n, half in ((20, 0.001), (3, 0.1)))
    found = meeting(a, b, ["site"])
    assert found.count() == 60
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
