"""Planar geometry as Spark column expressions. Coordinates are doubles, all bounds are closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


def rounded(v) -> Column:
    """Six digits as SQL rounds doubles: the product with 10^6 is rounded, not the decimal digits, which
    differs where these end in 5."""
    return F.round(_c(v) * 1e6) / 1e6


def number_text(v) -> Column:
    """A double in the least digits as SQL casts it to text, for six digits after the point at most; Spark
    has exponents below 0.001 and from 10^7 on, SQL below 0.0001 and from 10^16 on."""
    v = _c(v)
    plain = F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0*$", "$1")
    short = F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-(\d)$", "e-0$2")
    return F.when((v == 0) | F.abs(v).between(1e-4, 9_999_999_999_999_998.0), plain).otherwise(short)


def ring_text(points: list[tuple]) -> Column:
    """[[x,y],...] of pairs of columns, rounded to six digits."""
    pairs = [F.format_string("[%s,%s]", *[F.coalesce(number_text(rounded(v)), F.lit("null")) for v in p]) for p in points]
    return F.concat(F.lit("["), F.concat_ws(",", *pairs), F.lit("]"))


def point_point(ax, ay, bx, by) -> Column:
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def gap(low, high, at_low, at_high) -> Column:
    """Distance of two intervals, 0 if they meet."""
    return F.greatest(_c(low) - _c(at_high), F.lit(0.0), _c(at_low) - _c(high))


def mbr_mbr(a, b) -> Column:
    """Boxes are (xmin, ymin, xmax, ymax)."""
    dx, dy = gap(a[0], a[2], b[0], b[2]), gap(a[1], a[3], b[1], b[3])
    return F.sqrt(dx * dx + dy * dy)


def point_mbr(x, y, box) -> Column:
    return mbr_mbr((x, y, x, y), box)


def point_mbr_max(x, y, box) -> Column:
    dx = F.greatest(F.abs(_c(x) - _c(box[0])), F.abs(_c(x) - _c(box[2])))
    dy = F.greatest(F.abs(_c(y) - _c(box[1])), F.abs(_c(y) - _c(box[3])))
    return F.sqrt(dx * dx + dy * dy)


def point_segment(px, py, s) -> Column:
    """Clamped projection on (x1, y1, x2, y2); a segment without length is its end."""
    x1, y1, x2, y2 = map(_c, s)
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((_c(px) - x1) * dx + (_c(py) - y1) * dy) / F.when(square == 0, F.lit(1.0)).otherwise(square))))
    return point_point(_c(px), _c(py), x1 + t * dx, y1 + t * dy)


def _ends(a, b) -> list[Column]:
    return [point_segment(a[0], a[1], b), point_segment(a[2], a[3], b), point_segment(b[0], b[1], a), point_segment(b[2], b[3], a)]


def segment_match(a, b) -> Column:
    """Hausdorff distance of two segments."""
    return F.greatest(*_ends(a, b))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((_c(bx) - _c(ax)) * (_c(cy) - _c(ay)) - (_c(by) - _c(ay)) * (_c(cx) - _c(ax)))


def segment_contains(s, px, py) -> Column:
    x1, y1, x2, y2 = map(_c, s)
    return (_turn(x1, y1, x2, y2, px, py) == 0) & (_c(px) >= F.least(x1, x2)) & (_c(px) <= F.greatest(x1, x2)) & (_c(py) >= F.least(y1, y2)) & (_c(py) <= F.greatest(y1, y2))


def segments_intersect(a, b) -> Column:
    proper = (_turn(a[0], a[1], a[2], a[3], b[0], b[1]) * _turn(a[0], a[1], a[2], a[3], b[2], b[3]) < 0) & (_turn(b[0], b[1], b[2], b[3], a[0], a[1]) * _turn(b[0], b[1], b[2], b[3], a[2], a[3]) < 0)
    return proper | segment_contains(a, b[0], b[1]) | segment_contains(a, b[2], b[3]) | segment_contains(b, a[0], a[1]) | segment_contains(b, a[2], a[3])


def segment_min(a, b) -> Column:
    return F.when(segments_intersect(a, b), F.lit(0.0)).otherwise(F.least(*_ends(a, b)))


def mbr_contains(box, x, y) -> Column:
    return _c(x).between(_c(box[0]), _c(box[2])) & _c(y).between(_c(box[1]), _c(box[3]))


def mbr_intersects(a, b) -> Column:
    return (_c(a[0]) <= _c(b[2])) & (_c(b[0]) <= _c(a[2])) & (_c(a[1]) <= _c(b[3])) & (_c(b[1]) <= _c(a[3]))


def edges(box) -> list[tuple]:
    x0, y0, x1, y1 = box
    return [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]


def segment_intersects_mbr(s, box) -> Column:
    out = mbr_contains(box, s[0], s[1]) | mbr_contains(box, s[2], s[3])
    for e in edges(box):
        out = out | segments_intersect(s, e)
    return out


def segment_mbr(s, box) -> Column:
    return F.when(segment_intersects_mbr(s, box), F.lit(0.0)).otherwise(F.least(*[segment_min(s, e) for e in edges(box)]))


def segment_covers_mbr(s, box, r) -> Column:
    return F.greatest(*[point_segment(e[0], e[1], s) for e in edges(box)]) <= _c(r)


def overlap_ratio(box, query) -> Column:
    """Area of the intersection by the box's area; 0 unless they overlap in both dimensions."""
    w = F.least(_c(box[2]), _c(query[2])) - F.greatest(_c(box[0]), _c(query[0]))
    h = F.least(_c(box[3]), _c(query[3])) - F.greatest(_c(box[1]), _c(query[1]))
    return F.when((w > 0) & (h > 0), w * h / ((_c(box[2]) - _c(box[0])) * (_c(box[3]) - _c(box[1])))).otherwise(F.lit(0.0))


def circle_mbr(cx, cy, r, box) -> Column:
    return F.greatest(point_mbr(cx, cy, box) - _c(r), F.lit(0.0))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a sphere of radius 6371 km; arguments in degrees."""
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return F.lit(2 * 6371e3) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def zorder(values: list, bits: int) -> Column:
    """Interleave non-negative integers, highest bit first."""
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for v in values:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(F.col(v).cast("long"), b).bitwiseAND(F.lit(1).cast("long")))
    return out


def zorder_decode(z: Column, count: int, bits: int) -> list[Column]:
    """The ``count`` integers that ``zorder`` interleaved."""
    one = F.lit(1).cast("long")
    out = []
    for k in range(count):
        value = F.lit(0).cast("long")
        for b in range(bits):
            value = value.bitwiseOR(F.shiftleft(F.shiftright(z, b * count + count - 1 - k).bitwiseAND(one), b))
        out.append(value)
    return out
