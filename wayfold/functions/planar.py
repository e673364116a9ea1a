"""Shapes of columns or numbers with one ``intersects``, one ``min_dist``, boxes and text for all kinds.

Polygons and line strings are array columns, so their size isn't part of the plan. Bounds are closed:
shapes that touch intersect; ``Polygon.contains`` alone leaves out the boundary.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from .geometry import _c

_S = ("x1", "y1", "x2", "y2")


def _quad(e: Column) -> tuple[Column, ...]:
    return tuple(e[n] for n in _S)


def _segment_array(parts: list) -> Column:
    return F.array(*[F.struct(*[_c(v).alias(n) for v, n in zip(p, _S, strict=True)]) for p in parts])


@dataclass(frozen=True)
class Point:
    x: object
    y: object

    def shifted(self, by) -> Point:
        return Point(_c(self.x) + _c(by), _c(self.y) + _c(by))

    def equals(self, other: Point) -> Column:
        return (_c(self.x) == _c(other.x)) & (_c(self.y) == _c(other.y))

    def box(self) -> Box:
        return Box(self.x, self.y, self.x, self.y)

    def text(self) -> Column:
        return F.format_string("POINT(%.6f %.6f)", G.rounded(self.x), G.rounded(self.y))


@dataclass(frozen=True)
class Segment:
    x1: object
    y1: object
    x2: object
    y2: object

    @property
    def quad(self) -> tuple:
        return (self.x1, self.y1, self.x2, self.y2)

    def box(self) -> Box:
        return Box(F.least(_c(self.x1), _c(self.x2)), F.least(_c(self.y1), _c(self.y2)), F.greatest(_c(self.x1), _c(self.x2)), F.greatest(_c(self.y1), _c(self.y2)))

    def text(self) -> Column:
        return F.format_string("SEG(%.6f %.6f->%.6f %.6f)", *map(G.rounded, self.quad))


@dataclass(frozen=True)
class Box:
    xmin: object
    ymin: object
    xmax: object
    ymax: object

    @property
    def quad(self) -> tuple:
        return (self.xmin, self.ymin, self.xmax, self.ymax)

    def edges(self) -> Column:
        return _segment_array(G.edges(self.quad))

    def box(self) -> Box:
        return self

    def union(self, other: Box) -> Box:
        a, b = tuple(map(_c, self.quad)), tuple(map(_c, other.quad))
        return Box(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))

    def text(self) -> Column:
        return F.format_string("MBR(%.6f %.6f,%.6f %.6f)", *map(G.rounded, self.quad))


@dataclass(frozen=True)
class Circle:
    x: object
    y: object
    r: object

    def centre(self) -> Point:
        return Point(self.x, self.y)

    def contains(self, p: Point) -> Column:
        return G.point_point(self.x, self.y, p.x, p.y) <= _c(self.r)

    def box(self) -> Box:
        x, y, r = map(_c, (self.x, self.y, self.r))
        return Box(x - r, y - r, x + r, y + r)

    def text(self) -> Column:
        return F.format_string("CIRCLE(%.6f %.6f,%.6f)", *map(G.rounded, (self.x, self.y, self.r)))


@dataclass(frozen=True)
class LineString:
    """``parts``: an array column of structs x1, y1, x2, y2."""

    parts: Column

    @classmethod
    def of(cls, points: list[tuple[float, float]]) -> LineString:
        return cls(_segment_array([(*a, *b) for a, b in zip(points, points[1:])]))

    def edges(self) -> Column:
        return self.parts

    def box(self) -> Box:
        least = lambda f, *n: f(F.transform(self.parts, lambda e: (F.least if f is F.array_min else F.greatest)(*[e[x] for x in n])))
        return Box(least(F.array_min, "x1", "x2"), least(F.array_min, "y1", "y2"), least(F.array_max, "x1", "x2"), least(F.array_max, "y1", "y2"))

    def hausdorff(self, other: LineString) -> Column:
        """The larger of both directions; each is the largest of the least distances of segments."""
        one = lambda a, b: F.array_max(F.transform(a, lambda e: F.array_min(F.transform(b, lambda f: G.segment_min(_quad(e), _quad(f))))))
        return F.greatest(one(self.parts, other.parts), one(other.parts, self.parts))

    def text(self) -> Column:
        return _points_text("LINESTRING(", F.concat(F.transform(F.slice(self.parts, 1, 1), lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y"))), F.transform(self.parts, lambda e: F.struct(e["x2"].alias("x"), e["y2"].alias("y")))), ")")


@dataclass(frozen=True)
class Polygon:
    """``ring``: an array column of structs x, y, the last equal to the first."""

    ring: Column

    @classmethod
    def of(cls, points: list[tuple[float, float]]) -> Polygon:
        if len(points) < 4 or points[0] != points[-1] or any(len(p) != 2 for p in points):
            raise ValueError("a ring has three corners or more and ends where it begins")
        return cls(F.array(*[F.struct(_c(x).alias("x"), _c(y).alias("y")) for x, y in points]))

    def edges(self) -> Column:
        pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
        return F.zip_with(F.slice(self.ring, F.lit(1), F.size(self.ring) - 1), F.slice(self.ring, F.lit(2), F.size(self.ring) - 1), pair)

    def on_boundary(self, p: Point) -> Column:
        return F.exists(self.edges(), lambda e: G.segment_contains(_quad(e), _c(p.x), _c(p.y)))

    def holds(self, p: Point) -> Column:
        """Inside by crossings; says nothing about the boundary."""
        x, y = _c(p.x), _c(p.y)

        def crossed(n, e):
            rise = F.when(e["y1"] == e["y2"], F.lit(1.0)).otherwise(e["y2"] - e["y1"])
            hit = ((y < e["y1"]) != (y < e["y2"])) & (x < e["x1"] + (y - e["y1"]) * ((e["x2"] - e["x1"]) / rise))
            return n + F.when(hit, 1).otherwise(0)

        return F.aggregate(self.edges(), F.lit(0), crossed) % 2 == 1

    def contains(self, p: Point) -> Column:
        return self.holds(p) & ~self.on_boundary(p)

    def box(self) -> Box:
        of = lambda f, n: f(F.transform(self.ring, lambda p: p[n]))
        return Box(of(F.array_min, "x"), of(F.array_min, "y"), of(F.array_max, "x"), of(F.array_max, "y"))

    def corner(self) -> Point:
        first = F.element_at(self.ring, 1)
        return Point(first["x"], first["y"])

    def text(self) -> Column:
        return _points_text("POLYGON((", self.ring, "))")


def _points_text(begin: str, points: Column, end: str) -> Column:
    return F.concat(F.lit(begin), F.array_join(F.transform(points, lambda p: F.format_string("%.6f %.6f", G.rounded(p["x"]), G.rounded(p["y"]))), ", "), F.lit(end))


Shape = Point | Segment | Box | Circle | LineString | Polygon
_ORDER = (Point, Segment, Box, Circle, LineString, Polygon)


def _pairs(a: Column, b: Column, kernel: str) -> Column:
    """What ``kernel`` (of ``kernels.PAIRED``) says of all pairs of two arrays of segments; an Arrow kernel, since
    lambdas are interpreted node by node, and the expressions of coordinates again for each element."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        import numpy as np

        from . import kernels

        def quads(parts):
            flat = parts.flatten()  # without null rows
            fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
            return np.stack([fields[n].to_numpy(zero_copy_only=False).astype(float) for n in _S], axis=1)

        sizes = [p.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for p in (x, y)]
        out = kernels.row_pairs(quads(x), sizes[0], quads(y), sizes[1], *kernels.PAIRED[kernel])
        known = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(out, mask=~known | np.isnan(out))

    return run(a, b)


def _cross(a: Column, b: Column) -> Column:
    """Whether any two segments of two arrays meet; null if that isn't known for null coordinates."""
    met = _pairs(a, b, "meeting")
    return F.when(met != 0.5, met == 1.0)


def _held(p: Point, polygon: Polygon) -> Column:
    """``polygon.holds(p)`` as a kernel."""
    at = F.array(F.struct(*[_c(v).alias(n) for v, n in zip((p.x, p.y, p.x, p.y), _S, strict=True)]))
    return _pairs(polygon.edges(), at, "crossed") % 2 == 1


def _apart(a: Column, b: Column) -> Column:
    """The least distance of any two segments of two arrays."""
    return _pairs(a, b, "apart")


def _least(a: Column, quad) -> Column:
    return F.array_min(F.transform(a, lambda e: G.segment_min(_quad(e), quad)))


_MEET = {
    (Point, Point): lambda a, b: a.equals(b),
    (Point, Segment): lambda a, b: G.segment_contains(b.quad, _c(a.x), _c(a.y)),
    (Point, Box): lambda a, b: G.mbr_contains(b.quad, a.x, a.y),
    (Point, Circle): lambda a, b: b.contains(a),
    (Point, LineString): lambda a, b: F.exists(b.parts, lambda e: G.segment_contains(_quad(e), _c(a.x), _c(a.y))),
    (Point, Polygon): lambda a, b: b.holds(a) | b.on_boundary(a),
    (Segment, Segment): lambda a, b: G.segments_intersect(a.quad, b.quad),
    (Segment, Box): lambda a, b: G.segment_intersects_mbr(a.quad, b.quad),
    (Segment, Circle): lambda a, b: G.point_segment(b.x, b.y, a.quad) <= _c(b.r),
    (Segment, LineString): lambda a, b: F.exists(b.parts, lambda e: G.segments_intersect(_quad(e), a.quad)),
    (Segment, Polygon): lambda a, b: b.holds(Point(a.x1, a.y1)) | F.exists(b.edges(), lambda e: G.segments_intersect(_quad(e), a.quad)),
    (Box, Box): lambda a, b: G.mbr_intersects(a.quad, b.quad),
    (Box, Circle): lambda a, b: G.point_mbr(b.x, b.y, a.quad) <= _c(b.r),
    (Box, LineString): lambda a, b: F.exists(b.parts, lambda e: G.segment_intersects_mbr(_quad(e), a.quad)),
    (Box, Polygon): lambda a, b: _cross(a.edges(), b.edges()) | _held(Point(a.xmin, a.ymin), b) | G.mbr_contains(a.quad, b.corner().x, b.corner().y),
    (Circle, Circle): lambda a, b: G.point_point(a.x, a.y, b.x, b.y) <= _c(a.r) + _c(b.r),
    (Circle, LineString): lambda a, b: F.exists(b.parts, lambda e: G.point_segment(a.x, a.y, _quad(e)) <= _c(a.r)),
    (Circle, Polygon): lambda a, b: min_dist(a.centre(), b) <= _c(a.r),
    (LineString, LineString): lambda a, b: _cross(a.parts, b.parts),
    (LineString, Polygon): lambda a, b: F.exists(a.parts, lambda e: b.holds(Point(e["x1"], e["y1"]))) | _cross(a.parts, b.edges()),
    (Polygon, Polygon): lambda a, b: _cross(a.edges(), b.edges()) | _held(a.corner(), b) | _held(b.corner(), a),
}

_APART = {
    (Point, Point): lambda a, b: G.point_point(a.x, a.y, b.x, b.y),
    (Point, Segment): lambda a, b: G.point_segment(a.x, a.y, b.quad),
    (Point, Box): lambda a, b: G.point_mbr(a.x, a.y, b.quad),
    (Point, LineString): lambda a, b: F.array_min(F.transform(b.parts, lambda e: G.point_segment(a.x, a.y, _quad(e)))),
    (Point, Polygon): lambda a, b: F.when(b.holds(a), F.lit(0.0)).otherwise(F.array_min(F.transform(b.edges(), lambda e: G.point_segment(a.x, a.y, _quad(e))))),
    (Segment, Segment): lambda a, b: G.segment_min(a.quad, b.quad),
    (Segment, Box): lambda a, b: G.segment_mbr(a.quad, b.quad),
    (Segment, LineString): lambda a, b: _least(b.parts, a.quad),
    (Segment, Polygon): lambda a, b: F.when(b.holds(Point(a.x1, a.y1)), F.lit(0.0)).otherwise(_least(b.edges(), a.quad)),
    (Box, Box): lambda a, b: G.mbr_mbr(a.quad, b.quad),
    (Box, LineString): lambda a, b: F.when(F.exists(b.parts, lambda e: G.mbr_contains(a.quad, e["x1"], e["y1"]) | G.mbr_contains(a.quad, e["x2"], e["y2"])), F.lit(0.0)).otherwise(_apart(a.edges(), b.parts)),
    (Box, Polygon): lambda a, b: F.when(_held(Point(a.xmin, a.ymin), b) | G.mbr_contains(a.quad, b.corner().x, b.corner().y), F.lit(0.0)).otherwise(_apart(a.edges(), b.edges())),
    (LineString, LineString): lambda a, b: _apart(a.parts, b.parts),
    (LineString, Polygon): lambda a, b: F.when(F.exists(a.parts, lambda e: b.holds(Point(e["x1"], e["y1"]))), F.lit(0.0)).otherwise(_apart(a.parts, b.edges())),
    (Polygon, Polygon): lambda a, b: F.when(_held(a.corner(), b) | _held(b.corner(), a), F.lit(0.0)).otherwise(_apart(a.edges(), b.edges())),
}


def _ordered(a: Shape, b: Shape) -> tuple:
    return (a, b) if _ORDER.index(type(a)) <= _ORDER.index(type(b)) else (b, a)


def intersects(a: Shape, b: Shape) -> Column:
    a, b = _ordered(a, b)
    return _MEET[type(a), type(b)](a, b)


def min_dist(a: Shape, b: Shape) -> Column:
    """The least distance; that of a circle is its centre's less the radius, 0 at least."""
    for one, other in ((a, b), (b, a)):
        if isinstance(one, Circle):
            return F.greatest(min_dist(one.centre(), other) - _c(one.r), F.lit(0.0))
    a, b = _ordered(a, b)
    return _APART[type(a), type(b)](a, b)


# --- well-known binary -------------------------------------------------------------------------


def polygon_wkb(ring: Column) -> Column:
    """Little-endian WKB of a polygon of one ring (array of structs x, y)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def encode(rings: pa.Array) -> pa.Array:
        import struct

        import numpy as np

        out = []
        for points in rings:
            if not points.is_valid:
                out.append(None)
                continue
            xy = np.array([(p["x"], p["y"]) for p in points.as_py()], "<f8").reshape(-1, 2)
            out.append(struct.pack("<BIII", 1, 3, 1, len(xy)) + xy.tobytes())
        return pa.array(out, pa.binary())

    return encode(ring)


def polygon_of_wkb(data: Column) -> Column:
    """The outer ring of a polygon in WKB of either byte order; null for null, an error for other kinds."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<struct<x: double, y: double>>")
    def decode(blobs: pa.Array) -> pa.Array:
        import struct

        import numpy as np

        out = []
        for blob in blobs.to_pylist():
            if blob is None:
                out.append(None)
                continue
            order = "<" if blob[0] else ">"
            kind, _, n = struct.unpack(f"{order}III", blob[1:13])
            if kind != 3:
                raise ValueError(f"WKB kind {kind} isn't a polygon")
            out.append([{"x": x, "y": y} for x, y in np.frombuffer(blob, f"{order}f8", 2 * n, 13).reshape(-1, 2).tolist()])
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return decode(data)
