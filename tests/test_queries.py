import duckdb
import pandas as pd
import pytest

from sitelens.plans import registry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), c.sql(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_queries_without_sql(spark):
    """Those that plain passes are compared with elsewhere; they run over whole tables here."""
    rest = sorted(registry.QUERIES.keys() - registry.ORACLES.keys())
    assert rest == ["pin_turf", "refined_greens", "seed_parts"]
    for name in rest:
        assert registry.QUERIES[name](spark, DATA).count() > 100


def test_tag_ladder(spark):
    from pyspark.sql import functions as F

    from sitelens.functions.tags import layer

    rows = [
        ({"golf": "green;fairway"}, "green"),
        ({"golf": "fringe"}, "green_fringe"),
        ({"natural": "tree"}, "tree"),
        ({"leisure": "golf_course"}, "boundary"),
        ({"natural": "sand"}, "bunker"),
        ({"highway": "path"}, "walking_path"),
        ({"building": "yes", "name": "Club House"}, "clubhouse"),
        ({"highway": "service"}, None),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "tags map<string,string>, want string")
    assert df.where(~layer(F.col("tags")).eqNullSafe(F.col("want"))).count() == 0
