"""Layer of a map element by its tags, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Golf tag parts and their layers.
GOLF_LAYERS = {
    "fairway": "fairway",
    "green": "green",
    "fringe": "green_fringe",
    "collar": "green_fringe",
    "pin": "pin",
    "tee": "tee",
    "bunker": "bunker",
    "sand_bunker": "bunker",
    "water_hazard": "water",
    "lateral_water_hazard": "water",
    "rough": "managed_rough",
    "driving_range": "driving_range",
    "hole": "hole_centerline",
    "cartpath": "cart_path",
    "path": "cart_path",
    "practice": "putting_green",
    "putting_green": "putting_green",
}


def golf_layer(golf: Column) -> Column:
    """Layer of the first known part of a ;-separated golf tag, NULL if none is known."""
    known = F.create_map(*[F.lit(x) for kv in GOLF_LAYERS.items() for x in kv])
    layers = F.transform(F.split(golf, ";"), lambda p: F.try_element_at(known, F.trim(p)))
    return F.get(F.filter(layers, lambda x: x.isNotNull()), F.lit(0))


def layer(tags: Column) -> Column:
    """Layer of an element with these tags (map<string,string>), first matching rule wins; NULL drops it."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    some = lambda c: F.coalesce(c != "", F.lit(False))
    name, building = F.lower(F.coalesce(t("name"), F.lit(""))), some(t("building"))
    return (
        F.when(golf_layer(t("golf")).isNotNull(), golf_layer(t("golf")))
        .when(t("leisure") == "golf_course", "boundary")
        .when(t("amenity") == "parking", "parking")
        .when((t("natural") == "water") | some(t("water")), "water")
        .when((t("natural") == "sand") & ~some(t("golf")), "bunker")
        .when(t("waterway").isin("stream", "river", "ditch"), "stream")
        .when((t("landuse") == "forest") | (t("natural") == "wood"), "woodland")
        .when(t("natural") == "tree", "tree")
        .when(t("barrier") == "fence", "fence")
        .when((t("man_made") == "bridge") | t("bridge").isin("yes", "boardwalk"), "bridge")
        .when(building & (name.contains("club") | F.coalesce(t("tourism") == "hotel", F.lit(False))), "clubhouse")
        .when(building & (name.contains("maintenance") | name.contains("shed")), "maintenance")
        .when(building, "building")
        .when(t("highway").isin("path", "footway"), "walking_path")
        .when(t("highway").isin("service", "track") & some(t("golf")), "cart_path")
        .when(t("highway").isin("residential", "unclassified", "tertiary", "secondary"), "road")
    )
