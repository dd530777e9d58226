"""Completeness score of a site from the counts of its layers and its tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.numbering import number

# Counters by layer, layers counted as ways too, weights of the score's terms, kinds of small sites.
COUNTERS = {
    "green": "green",
    "fairway": "fairway",
    "tee": "tee",
    "bunker": "bunker",
    "hole_centerline": "hole",
    "cart_path": "cart_path",
    "water": "water",
    "lake": "water",
    "pin": "pin",
    "managed_rough": "rough",
    "natural_rough": "rough",
    "green_fringe": "fringe",
    "driving_range": "driving_range",
    "putting_green": "putting_green",
}
WAYS = ["green", "fairway", "tee", "hole"]
WEIGHTS = {"green": 24, "fairway": 20, "tee": 14, "hole": 16, "bunker": 10, "cart_path": 8, "water": 3, "pin": 2, "rough": 2, "named": 3}
SMALL_KINDS = ["miniature", "pitch_and_putt", "par_3", "par3", "disc_golf"]
SMALL_NAMES = ["mini golf", "miniature", "disc golf"]
NAMES = list(dict.fromkeys(COUNTERS.values()))


def counts(assigned: DataFrame) -> DataFrame:
    """Per site the counters of layers and of ways among them; assigned: (site, layer, way)."""
    layers = {v: [k for k, x in COUNTERS.items() if x == v] for v in NAMES}
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    each = [n(F.col("layer").isin(layers[v])).alias(v) for v in NAMES]
    ways = [n(F.col("layer").isin(layers[v]) & F.col("way")).alias(f"{v}_ways") for v in WAYS]
    return assigned.groupBy("site").agg(*each, *ways)


def small(name: Column, kind: Column) -> Column:
    """Whether a site is a small one by a part of its kind tag or by its name."""
    parts = F.transform(F.split(F.lower(F.coalesce(kind, F.lit(""))), ";"), lambda x: F.trim(x))
    low = F.lower(F.coalesce(name, F.lit("")))
    found = F.arrays_overlap(parts, F.array(*[F.lit(k) for k in SMALL_KINDS]))
    for word in SMALL_NAMES:
        found = found | low.contains(word)
    return found


def expected_holes() -> Column:
    """9, 18, 27 or 36: the tag where it says so, else by the counters."""
    tagged = F.trim("holes").try_cast("double").try_cast("int")
    hint = F.greatest("green", "hole", "fairway", "green_ways", "hole_ways")
    guess = F.when(hint >= 33, 36).when(hint >= 24, 27).when(hint >= 14, 18).when(hint >= 7, 9).otherwise(18)
    return F.when(tagged.isin(9, 18, 27, 36), tagged).otherwise(guess)


def scored(sites: DataFrame, assigned: DataFrame) -> DataFrame:
    """sites(site, name, holes, golf) with counters, expected, points of each term, score (3 decimals) and flags."""
    return scored_counts(sites, counts(assigned))


def scored_counts(sites: DataFrame, counters: DataFrame) -> DataFrame:
    zero = {c: 0 for c in [*NAMES, *[f"{v}_ways" for v in WAYS]]}
    c = sites.select("site", "name", "holes", "golf").join(counters, "site", "left").fillna(zero).withColumn("expected", expected_holes())
    want, unnamed = F.col("expected").cast("double"), F.trim(F.coalesce("name", F.lit(""))) == ""
    target = {k: want for k in ("green", "fairway", "tee", "hole", "pin")} | {"bunker": F.greatest(F.lit(6.0), want * 0.75)}
    seen = {k: F.col(k) for k in WEIGHTS if k != "named"} | {"named": F.when(unnamed, 0.0).otherwise(1.0)}
    points = {k: F.lit(float(w)) * F.least(seen[k] / target.get(k, F.lit(1.0)), F.lit(1.0)) for k, w in WEIGHTS.items()}
    nodes, only, tiny = (F.col("green_ways") == 0) & (F.col("green") > 0), (F.col("green") == 0) & (F.col("driving_range") > 0), small(F.col("name"), F.col("golf"))
    score = sum(points.values(), F.lit(0.0))
    for cond, factor in ((nodes, 0.85), (tiny, 0.35), (only, 0.30)):
        score = score * F.when(cond, factor).otherwise(1.0)
    flags = F.concat_ws(
        ";",
        F.when(nodes, "green_nodes_only"),
        F.when(F.col("green") < want * 0.5, "incomplete_core"),
        F.when(unnamed, "unnamed"),
        F.when(tiny, "miniature"),
        F.when(only, "driving_range_only"),
        F.when((F.col("green") == 0) & (F.col("fairway") == 0) & (F.col("hole") == 0), "boundary_only"),
    )
    out = c.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 3)).withColumn("flags", flags)
    return out.withColumns({f"points_{k}": F.round(x, 3) for k, x in points.items()})


def ranked(sites: DataFrame, assigned: DataFrame) -> DataFrame:
    """What scored gives, with the rank: best score, most greens, name in lower case, all downwards; sites alike in these by number."""
    return ranked_counts(sites, counts(assigned))


def ranked_counts(sites: DataFrame, counters: DataFrame) -> DataFrame:
    """The ranking out of sites and their counters."""
    out = scored_counts(sites, counters).withColumn("low", F.lower(F.trim(F.coalesce("name", F.lit("")))))
    return number(out, [F.desc("score"), F.desc("green"), F.desc("low"), F.asc("site")], "rank").drop("low")


def training_rows(ranking: DataFrame, top: int = 100, min_score: float = 100.0) -> DataFrame:
    """The first top rows of a ranking with at least min_score that are neither small nor ranges (a top-k report)."""
    fit = ~F.col("flags").contains("miniature") & ~F.col("flags").contains("driving_range_only") & (F.col("score") >= min_score)
    return ranking.where(fit).orderBy("rank").limit(top)
