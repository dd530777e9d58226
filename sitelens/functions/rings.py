"""Measures of rings held as arrays of (x, y) structs, the first point not repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), turned.alias("b"))


def once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def from_first(ring: Column) -> Column:
    """A ring or line seen from its first point, so that nothing large cancels in its measures."""
    return once(ring, lambda r: F.transform(r, lambda p: F.struct((p.x - r[0].x).alias("x"), (p.y - r[0].y).alias("y"))))


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e.b.x - e.a.x, e.b.y - e.a.y))


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter squared, 0 for a ring without extent."""
    p = perimeter(ring)
    return F.when(p > 0, F.lit(4.0) * F.pi() * area(ring) / (p * p)).otherwise(0.0)


def signed_area(ring: Column) -> Column:
    return once(ring, lambda r: F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def centroid(ring: Column) -> Column:
    """struct(x, y), NULL for a ring without extent."""
    a = signed_area(ring)
    cross = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    x = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e.a.x + e.b.x) * cross(e))
    y = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e.a.y + e.b.y) * cross(e))
    return F.when(a != 0, F.struct((x / (a * 6)).alias("x"), (y / (a * 6)).alias("y")))


def bounds(ring: Column) -> Column:
    """struct(west, south, east, north)."""
    x, y = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))


def clip(ring: Column, convex: Column) -> Column:
    """The part of a ring within a convex ring (anticlockwise), edge by edge: what lies left of each edge stays, crossings are added."""
    side = lambda e, p: (e.b.x - e.a.x) * (p.y - e.a.y) - (e.b.y - e.a.y) * (p.x - e.a.x)

    def by_edge(held: Column, e: Column) -> Column:
        def pieces(s: Column) -> Column:
            def cut(at: Column) -> Column:
                a, b = at.a, at.b
                t = a / (a - b)
                cross = F.array(F.struct((s.a.x + t * (s.b.x - s.a.x)).alias("x"), (s.a.y + t * (s.b.y - s.a.y)).alias("y")))
                end, none = F.array(s.b), F.slice(F.array(s.b), 1, 0)
                return F.when((a >= 0) & (b >= 0), end).when((a >= 0) & (b < 0), cross).when((a < 0) & (b >= 0), F.concat(cross, end)).otherwise(none)

            return once(F.struct(side(e, s.a).alias("a"), side(e, s.b).alias("b")), cut)

        return F.flatten(F.transform(_edges(held), pieces))

    return F.aggregate(_edges(convex), ring, by_edge)


def overlap(ring: Column, convex: Column) -> Column:
    """Area that a ring and a convex one share, 0 where they do not meet."""
    return F.coalesce(area(clip(ring, convex)), F.lit(0.0))


def box_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Area that two boxes (west, south, east, north) share: what overlap gives for them, without clipping."""
    wide, high = (F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]) for k in range(2))
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(ring: Column, convex: Column) -> Column:
    return once(F.struct(overlap(ring, convex).alias("both"), (area(ring) + area(convex)).alias("sum")), lambda s: F.when(s["sum"] > s["both"], s["both"] / (s["sum"] - s["both"])).otherwise(0.0))


def box(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n))])


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within a ring, by the parity of the edges that a ray to the east meets."""
    crosses = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)
    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def elongation(hull: Column) -> Column:
    """Length over width of the smallest rectangle around a convex ring: one side lies along an edge. 99 where it has no width."""

    def along(e: Column) -> Column:
        size = F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)

        def measured(u: Column) -> Column:
            far, off = F.transform(hull, lambda p: p.x * u.x + p.y * u.y), F.transform(hull, lambda p: p.y * u.x - p.x * u.y)
            spans = F.struct((F.array_max(far) - F.array_min(far)).alias("f"), (F.array_max(off) - F.array_min(off)).alias("o"))
            # of rectangles alike in area (to rounding) the least elongated
            ratio = lambda s: F.greatest(s.f, s.o) / F.least(s.f, s.o)
            return once(spans, lambda s: F.struct(F.round(s.f * s.o, 12).alias("area"), F.when(F.least(s.f, s.o) > 0, ratio(s)).otherwise(99.0).alias("ratio")))

        return once(F.struct(((e.b.x - e.a.x) / size).alias("x"), ((e.b.y - e.a.y) / size).alias("y")), measured)

    some = F.filter(_edges(hull), lambda e: (e.a.x != e.b.x) | (e.a.y != e.b.y))
    return F.coalesce(F.array_min(F.transform(some, along)).ratio, F.lit(99.0))
