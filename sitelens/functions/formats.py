"""Features as text: GeoJSON, WKT, KML and GPX; a geometry is its kind with an array of (x, y) structs (rings without the repeated end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _closed(kind: Column, points: Column) -> Column:
    return F.when(kind == "Polygon", F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def _joined(kind: Column, points: Column, between: str, of_point) -> Column:
    return F.array_join(F.transform(_closed(kind, points), of_point), between)


def _number(c: Column) -> Column:
    return F.format_string("%.7f", c)


def geojson(kind: Column, points: Column, layer: Column, title: Column, properties: dict[str, Column]) -> Column:
    """One feature as a GeoJSON object; the layer and its title are properties too. Null properties are left out."""
    coords = _joined(kind, points, ",", lambda p: F.concat(F.lit("["), _number(p.x), F.lit(","), _number(p.y), F.lit("]")))
    coords = F.when(kind == "Polygon", F.concat(F.lit("[["), coords, F.lit("]]"))).when(kind == "LineString", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords)
    props = F.to_json(F.struct(*[v.alias(k) for k, v in properties.items()], layer.alias("layer"), title.alias("layer_title")))
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), props, F.lit("}"))


def wkt(kind: Column, points: Column) -> Column:
    coords = _joined(kind, points, ", ", lambda p: F.concat(_number(p.x), F.lit(" "), _number(p.y)))
    shape = F.when(kind == "Polygon", F.concat(F.lit("(("), coords, F.lit("))"))).otherwise(F.concat(F.lit("("), coords, F.lit(")")))
    return F.concat(F.upper(kind), F.lit(" "), shape)


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def placemark(kind: Column, points: Column, name: Column) -> Column:
    """One feature of a KML folder."""
    coords = _joined(kind, points, " ", lambda p: F.concat(_number(p.x), F.lit(","), _number(p.y), F.lit(",0")))
    coords = F.concat(F.lit("<coordinates>"), coords, F.lit("</coordinates>"))
    ring = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing>"), coords, F.lit("</LinearRing></outerBoundaryIs></Polygon>"))
    shape = F.when(kind == "Polygon", ring).otherwise(F.concat(F.lit("<"), kind, F.lit(">"), coords, F.lit("</"), kind, F.lit(">")))
    return F.concat(F.lit("<Placemark><name>"), _escaped(name), F.lit("</name>"), shape, F.lit("</Placemark>"))


def track(points: Column, name: Column) -> Column:
    """A line as a GPX track."""
    dots = F.array_join(F.transform(points, lambda p: F.concat(F.lit('<trkpt lon="'), _number(p.x), F.lit('" lat="'), _number(p.y), F.lit('"></trkpt>'))), "")
    return F.concat(F.lit("<trk><name>"), _escaped(name), F.lit("</name><trkseg>"), dots, F.lit("</trkseg></trk>"))


def dxf(kind: Column, points: Column, layer: Column) -> Column:
    """One feature as lines of a DXF entity: polygons as closed polylines, lines as open ones, points; NULL for other kinds."""
    vertices = _joined(kind, points, "\n", lambda p: F.concat(F.lit("10\n"), _number(p.x), F.lit("\n20\n"), _number(p.y)))
    head = lambda name: F.concat(F.lit(f"0\n{name}\n8\n"), layer, F.lit("\n"))
    line = F.concat(head("LWPOLYLINE"), F.lit("90\n"), F.size(_closed(kind, points)), F.lit("\n70\n"), F.when(kind == "Polygon", "1").otherwise("0"), F.lit("\n"), vertices)
    return F.when(kind.isin("Polygon", "LineString"), line).when(kind == "Point", F.concat(head("POINT"), vertices, F.lit("\n30\n0.0")))
