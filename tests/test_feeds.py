import json
import random

import pytest

from sitelens.operators import completeness, tiling
from sitelens.operators.spatial import assign_to_sites
from sitelens.sources import layered
from sitelens.sources.regions import regions, tiles
from sitelens.streaming.ranking import ELEMENTS, rank_arrivals


def test_quarters_hold_what_they_may(spark):
    r = random.Random(2)
    points = [(r.gauss(0.3, 0.01), r.gauss(0.4, 0.2)) for _ in range(900)] + [(0.9, 0.9)] * 40
    points = [(min(max(x, 0.0), 1.0), min(max(y, 0.0), 1.0)) for x, y in points]
    box = regions(spark, box=(0, 0, 1, 1))
    placed = tiling.in_tiles(spark.createDataFrame(points, "lon double, lat double"), box, 0.5)
    got = tiling.leaves(placed, 30).collect()

    def split(x, y, size, level, held):  # plain recursion
        if not held:
            return []
        if len(held) <= 30 or level == 3:
            return [(level, round(x, 6), round(y, 6), len(held), len(held) > 30)]
        out, half = [], size / 2
        for i in (0, 1):
            for j in (0, 1):
                a, b = x + i * half, y + j * half
                part = [p for p in held if min(int((p[0] - x) / half), 1) == i and min(int((p[1] - y) / half), 1) == j]
                out += split(a, b, half, level + 1, part)
        return out

    want = []
    for i in (0, 1):
        for j in (0, 1):
            want += split(i * 0.5, j * 0.5, 0.5, 0, [p for p in points if min(int(p[0] / 0.5), 1) == i and min(int(p[1] / 0.5), 1) == j])
    at = lambda g, k, c: round((g[k] + g[c] / 2 ** g.level) * 0.5, 6)
    assert sorted((g.level, at(g, "i", "lx"), at(g, "j", "ly"), g.n, g.full) for g in got) == sorted(want)
    assert sum(g.n for g in tiling.merged(placed, 30).collect()) == len(points)
    assert tiling.leaves(placed.limit(0), 30).count() == 0


def test_regions_and_groups(spark):
    assert regions(spark, " Lisbon ").count() == 1 and regions(spark, "europe").count() == 6 and regions(spark, "global").count() == 22
    assert [tuple(r) for r in regions(spark, "lisbon", (1, 2, 3, 4)).collect()] == [("bbox", 1.0, 2.0, 3.0, 4.0)]
    with pytest.raises(ValueError):
        regions(spark, "atlantis")
    got = sorted((t.west, t.south, t.east, t.north) for t in tiles(regions(spark, box=(0, 0, 20, 10)), 8.0).collect())
    assert got == [(w, s, min(w + 8, 20), min(s + 8, 10)) for w in (0, 8, 16) for s in (0, 8)]


def test_collections_are_read_as_written(spark, tmp_path):
    path = str(tmp_path / "layers")
    feature = lambda layer, k: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, 1]}, "properties": {"layer": layer, "id": k, "name": "ü\n,"}}, separators=(",", ":"))
    rows = [(layer, feature(layer, k)) for k in range(50) for layer in ("green", "pin", "fairway")[: k % 3 + 1]] + [(None, "x"), ("pin", None)]
    df = spark.createDataFrame(rows, "layer string, feature string").repartition(4)
    layered.write_layers(df, path)
    want = sorted(r for r in rows if None not in r)
    assert sorted(map(tuple, layered.read_layers(spark, path).collect())) == want
    assert sorted(map(tuple, layered.read_layers(spark, path, ["pin"]).collect())) == [r for r in want if r[0] == "pin"]
    m = layered.manifest(path)
    assert m["layers"] == {"fairway": 16, "green": 50, "pin": 33}
    for f in m["files"]:  # every file is a collection of its own
        whole = json.loads((tmp_path / "layers" / f["name"]).read_text())
        assert whole["type"] == "FeatureCollection" and len(whole["features"]) == f["features"]
    layered.write_layers(df.where("layer = 'pin'"), path, "append")
    assert layered.read_layers(spark, path, ["pin"]).count() == 66
    layered.write_layers(df.limit(0), path)
    assert layered.read_layers(spark, path).count() == 0 and list((tmp_path / "layers").iterdir()) == [tmp_path / "layers" / "manifest.json"]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "layers")
    layered.write_layers(spark.createDataFrame([("pin", '{"type":"Feature"}')], "layer string, feature string"), path)
    bad = spark.range(100).select(F.lit("pin").alias("layer"), F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.lit('{"type":"Feature"}')).alias("feature"))
    with pytest.raises(Exception):
        layered.write_layers(bad, path, "append")
    assert layered.read_layers(spark, path).count() == 1


@pytest.mark.parametrize("seed", [1])
def test_arrivals_in_any_order_give_the_batch_ranking(spark, tmp_path, seed):
    r = random.Random(seed)
    places = [(k, f"S{k}", None, None, r.random() / 4, r.random() / 4, None, None, None, None) for k in range(12)]
    things = [(k, r.choice(["green", "fairway", "tee", "bunker", None]), r.random() < 0.5, r.random() / 4, r.random() / 4) for k in range(300)]
    files = [[] for _ in range(4)]
    for p in places:
        files[r.randrange(4)].append((*p, None, None, None))
    for k, layer, way, lon, lat in things:
        row = (None, None, None, None, lon, lat, None, None, None, None, k, layer, way)
        for n in r.sample(range(4), r.choice([1, 1, 2])):  # some come twice
            files[n].append(row)
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, ELEMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state, batches = rank_arrivals(spark, str(tmp_path / "in"))
    sites = spark.createDataFrame([(*p,) for p in places], ELEMENTS.split(", feat")[0])
    feats = spark.createDataFrame([(k, layer, way, lon, lat) for k, layer, way, lon, lat in things], "feat long, layer string, way boolean, lon double, lat double")
    want = completeness.ranked(sites, assign_to_sites(feats, sites))
    assert batches == 4
    assert sorted(map(str, state.final(batches).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # what was counted or waits are all features that came, each once
    last = state.snapshot(batches - 1)
    counted = spark.read.parquet(*[f"{state.path}/found/{n}" for n in range(batches)])
    assert counted.count() + state.waiting(batches - 1).count() == 300 and last.count() == 12
    state.step(spark.createDataFrame(files[3], ELEMENTS), batches)  # nothing new
    assert state.snapshot(batches).count() == 12 and counted.count() + state.waiting(batches).count() <= 300
