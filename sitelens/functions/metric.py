"""Metres and degrees: distances, shifts, boxes and web-map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import rings

# Metres of a degree, greatest latitude of the web map, tiles of one mosaic.
METRES, TOP, MOSAIC = 111_320.0, 85.05112878, 400

Box = tuple[Column, Column, Column, Column]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance in degrees, in metres of a degree."""
    return F.hypot(ax - bx, ay - by) * METRES


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance in metres from a point to the segment from a to b."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return distance(px, py, ax + t * dx, ay + t * dy)


def shift(lon: Column, lat: Column, east: Column | float, north: Column | float) -> tuple[Column, Column]:
    """A point moved by metres."""
    return lon + east / (METRES * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))), lat + north / METRES


def around(lon: Column, lat: Column, radius: float) -> Box:
    """west, south, east, north of a square of radius metres."""
    dlat, dlon = radius / METRES, F.lit(radius) / (F.lit(METRES) * F.greatest(F.lit(0.15), F.cos(F.radians(lat))))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def expand(box: Box, pad: float) -> Box:
    w, s, e, n = box
    return w - pad, s - pad, e + pad, n + pad


def or_default(box: Box, lon: Column, lat: Column, pad: float = 0.012) -> Box:
    """The box where it has an extent, else one of pad degrees around the point."""
    w, s, e, n = box
    fine = F.coalesce((e > w) & (n > s), F.lit(False))
    return tuple(F.when(fine, x).otherwise(c + d) for x, c, d in ((w, lon, -pad), (s, lat, -pad), (e, lon, pad), (n, lat, pad)))


def valid(lon: Column, lat: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def world(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Place on the web map in tiles of a zoom, latitudes held to the map's."""
    r, n = F.radians(F.least(F.greatest(lat, F.lit(-TOP)), F.lit(TOP))), float(2**zoom)
    return (lon + 180.0) / 360.0 * n, (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0 * n


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    x, y = world(lon, lat, zoom)
    return F.floor(x).cast("long"), F.floor(y).cast("long")


def lonlat(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """The inverse of world."""
    n = float(2**zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * y / n))))


def map_box(lon: Column, lat: Column, zoom: int, size: int) -> Box:
    """Extent of a square map of size pixels around a point."""
    x, y = world(lon, lat, zoom)
    half = size / 2.0 / 256.0
    (w, n), (e, s) = lonlat(x - half, y - half, zoom), lonlat(x + half, y + half, zoom)
    return w, s, e, n


def fit_zoom(box: Box, greatest: int = 18, least: int = 12) -> Column:
    """The greatest zoom at which the box takes at most MOSAIC tiles, least where none above it does."""
    w, s, e, n = box
    out = F.lit(least)
    for zoom in range(least, greatest + 1):
        (x0, y1), (x1, y0) = tile(w, s, zoom), tile(e, n, zoom)
        fits = (F.abs(x1 - x0) + 1) * (F.abs(y1 - y0) + 1) <= MOSAIC
        out = F.when(fits, zoom).otherwise(out) if zoom > least else out
    return out


# The WGS84 ellipsoid's radius and flattening.
RADIUS, FLAT = 6_378_137.0, 1 / 298.257223563


def ellipsoid_area(ring: Column) -> Column:
    """Square metres of a ring of (x: longitude, y: latitude) on the ellipsoid, edges straight in longitude and authalic latitude."""
    e = math.sqrt(FLAT * (2 - FLAT))

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return (F.lit(1 - e * e)) * (s / (F.lit(1.0) - s * s * (e * e)) - F.lit(1 / (2 * e)) * F.log((F.lit(1.0) - s * e) / (F.lit(1.0) + s * e)))

    def flat(corners: Column) -> Column:
        # from the first corner on, so that nothing large cancels
        at = F.element_at(corners, 1)
        return F.transform(corners, lambda p: F.struct((p.x - at.x).alias("x"), (p.y - at.y).alias("y")))

    even = rings.once(F.transform(ring, lambda p: F.struct(F.radians(p.x).alias("x"), q(p.y).alias("y"))), flat)
    return rings.area(even) * (RADIUS * RADIUS / 2)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres of the web map."""
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2)


def pad_box(box: Box, metres: float) -> Box:
    """The box of what lies within metres of the web map around a shape with the given box."""
    w, s, e, n = box
    (x0, y0), (x1, y1) = mercator(w, s), mercator(e, n)
    return (*from_mercator(x0 - metres, y0 - metres), *from_mercator(x1 + metres, y1 + metres))


def capsule(ax: Column, ay: Column, bx: Column, by: Column, metres: float, quarter: int = 16) -> Column:
    """Ring of what lies within metres of the web map of the segment from a to b, arcs of quarter chords a quarter; a circle where a is b."""
    (x0, y0), (x1, y1) = mercator(ax, ay), mercator(bx, by)
    way = F.atan2(y1 - y0, x1 - x0)

    def arc(x: Column, y: Column, start: float) -> Column:
        def at(k: Column) -> Column:
            turn = way + F.lit(start) + k * (math.pi / 2 / quarter)
            lon, lat = from_mercator(x + F.cos(turn) * metres, y + F.sin(turn) * metres)
            return F.struct(lon.alias("x"), lat.alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(2 * quarter)), at)

    return F.concat(arc(x1, y1, -math.pi / 2), arc(x0, y0, math.pi / 2))
