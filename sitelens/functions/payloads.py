"""Catalog answers as JSON text: courses of clubs, points of courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import names



def _first(row: Column, *keys: str) -> Column:
    """The first of the keys with a value other than null, empty text, zero or false."""
    each = [F.try_element_at(row, F.lit(k)) for k in keys]
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0", "false"), v) for v in each])


def _number(v: Column) -> Column:
    return F.trim(v).try_cast("double")


def points(df: DataFrame, key: str, payload: str, holes: Column | None = None) -> DataFrame:
    """(key, place, hole, kind, lat, lon) of each point in a payload: a list, or an object with a list under coordinates, pois, points
    or data. Rows that are no objects or have no place are dropped; hole numbers above holes wrap round; of points alike in hole, kind and place to 6
    decimals the first stays. Texts that are no JSON give no rows."""
    text = F.col(payload)
    lists = [text, *[F.get_json_object(text, f"$.{k}") for k in ("coordinates", "pois", "points", "data")]]
    rows = F.coalesce(*[F.when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, "array<string>")) for t in lists])
    r = df.select(key, F.posexplode(rows).alias("place", "text"), (F.lit(None).cast("int") if holes is None else holes).alias("holes"))
    r = r.withColumn("row", F.from_json("text", "map<string,string>"))
    row = F.col("row")
    hole = _number(_first(row, "hole", "holeNumber", "hole_number", "no")).cast("long")
    hole = F.when((F.col("holes") >= 1) & (hole > F.col("holes")), (hole - 1) % F.col("holes") + 1).otherwise(hole)
    # columns of their own: the kind names its text many times
    r = r.withColumn("raw", _first(row, "poi", "poiType", "poi_type", "type", "locationType", "pointType", "name")).withColumn("kind", names.point_kind(F.col("raw")))
    kind = F.col("kind")
    middle = (kind == "green") & (_number(_first(row, "location")).cast("long") == 2)
    r = r.select(key, "place", hole.alias("hole"), F.when(middle, "pin").otherwise(kind).alias("kind"), _number(_first(row, "latitude", "lat")).alias("lat"), _number(_first(row, "longitude", "lng", "lon")).alias("lon"))
    alike = [key, "hole", "kind", F.round("lat", 6).alias("_lat"), F.round("lon", 6).alias("_lon")]
    first = r.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(*alike).agg(F.min(F.struct("place", "lat", "lon")).alias("f"))
    return first.select(key, "f.place", "hole", "kind", "f.lat", "f.lon")


_CLUBS = "array<struct<clubID:string,club_id:string,clubName:string,club_name:string,city:string,latitude:string,longitude:string,lng:string,courses:array<map<string,string>>>>"


def courses(df: DataFrame, payload: str) -> DataFrame:
    """A row for each course of each club in payloads {"clubs": [...]}: clubs without courses and courses without an id are dropped, a
    club's place comes before its course's, a course without a name has its club's."""
    club = df.select(F.explode(F.from_json(F.get_json_object(payload, "$.clubs"), _CLUBS)).alias("c"))
    r = club.select("c", F.explode("c.courses").alias("row"))
    row, some = F.col("row"), lambda v: F.when(F.trim(v) != "", v)
    place = lambda v: F.when(~v.isin("", "0", "0.0"), v)
    name = F.trim(F.coalesce(some(F.col("c.clubName")), some(F.col("c.club_name")), F.lit("")))
    out = r.select(
        F.coalesce(some(F.col("c.clubID")), F.col("c.club_id"), F.lit("")).alias("club_id"),
        name.alias("club_name"),
        _first(row, "courseID", "course_id").alias("course_id"),
        F.trim(F.coalesce(_first(row, "courseName", "course_name"), name)).alias("course_name"),
        some(F.col("c.city")).alias("city"),
        _number(F.coalesce(place(F.col("c.latitude")), _first(row, "latitude"))).alias("lat"),
        _number(F.coalesce(place(F.col("c.longitude")), place(F.col("c.lng")), _first(row, "longitude"))).alias("lon"),
        _number(_first(row, "numHoles", "num_holes")).cast("long").alias("num_holes"),
        F.lower(F.coalesce(_first(row, "hasGPS", "has_gps"), F.lit(""))).isin("1", "true", "yes", "y").alias("has_gps"),
    )
    return out.where("course_id IS NOT NULL")
