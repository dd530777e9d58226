"""Named regions, groups of them, and their tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions (west, south, east, north) and groups of regions.
REGIONS = {
    "lisbon": (-9.55, 38.60, -9.05, 38.90),
    "portugal": (-9.70, 36.90, -6.10, 42.20),
    "iberia": (-10.00, 35.50, 4.00, 44.00),
    "uk_ireland": (-11.00, 49.00, 2.20, 61.00),
    "france": (-5.50, 42.00, 8.50, 51.50),
    "central_europe": (4.00, 45.00, 25.00, 55.50),
    "nordics": (4.00, 54.50, 32.00, 71.00),
    "eastern_europe": (20.00, 41.00, 42.00, 56.00),
    "usa_west": (-125.00, 32.00, -102.00, 49.50),
    "usa_central": (-102.00, 25.50, -84.00, 49.50),
    "usa_east": (-84.00, 24.00, -66.50, 47.50),
    "canada": (-140.00, 42.00, -52.00, 60.00),
    "mexico_caribbean": (-118.00, 14.00, -60.00, 32.50),
    "hawaii": (-161.00, 18.50, -154.50, 22.50),
    "japan": (128.00, 30.00, 146.00, 46.00),
    "korea": (124.50, 33.00, 132.00, 39.00),
    "china_east": (110.00, 18.00, 123.00, 41.00),
    "se_asia": (99.00, -9.00, 121.00, 22.00),
    "australia": (113.00, -45.00, 154.00, -10.00),
    "new_zealand": (166.00, -47.50, 179.00, -34.00),
    "southern_africa": (16.00, -35.00, 33.00, -22.00),
    "south_america": (-78.00, -42.00, -34.00, 5.00),
    "india": (68.00, 8.00, 89.00, 35.00),
    "middle_east": (32.00, 22.00, 60.00, 38.00),
}
GROUPS = {
    "europe": ("iberia", "uk_ireland", "france", "central_europe", "nordics", "eastern_europe"),
    "north_america": ("usa_west", "usa_central", "usa_east", "canada", "mexico_caribbean", "hawaii"),
    "asia_pacific": ("japan", "korea", "china_east", "se_asia", "australia", "new_zealand", "india"),
    "global": tuple(r for r in REGIONS if r not in ("lisbon", "portugal")),
}


def regions(spark: SparkSession, name: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(region, west, south, east, north): a box of one's own (first), a region or the members of a group. An unknown name raises."""
    if box is not None:
        rows = [("bbox", *map(float, box))]
    else:
        key = (name or "").strip().lower()
        if key not in REGIONS and key not in GROUPS:
            raise ValueError(f"no region {name!r}; known are {', '.join([*sorted(REGIONS), *sorted(GROUPS)])}")
        rows = [(r, *REGIONS[r]) for r in ([key] if key in REGIONS else GROUPS[key])]
    return spark.createDataFrame(rows, "region string, west double, south double, east double, north double")


def tiles(boxes: DataFrame, step: float) -> DataFrame:
    """boxes(region, west, ...) dealt into tiles of step degrees from the south-west: (region, i, j, west, south, east, north), the last ones cut off."""
    count = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a) - 1e-12) / step).cast("int"), F.lit(0))
    some = boxes.where((count("west", "east") > 0) & (count("south", "north") > 0))
    t = some.withColumn("i", F.explode(F.sequence(F.lit(0), count("west", "east") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), count("south", "north") - 1)))
    at = lambda low, k, high: F.least(F.col(low) + k * step, F.col(high))
    return t.select("region", "i", "j", at("west", F.col("i"), "east").alias("west"), at("south", F.col("j"), "north").alias("south"), at("west", F.col("i") + 1, "east").alias("east"), at("south", F.col("j") + 1, "north").alias("north"))
