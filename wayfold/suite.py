"""Queries of the trajectory operators over the driver's tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as G
from .operators import idsets, layout, ranges, search, shapes, trajectories as T
from .sources.trajectories import event_points, event_segments, order_segments

QUERY = 7
SEG, BOX = ("x1", "y1", "x2", "y2"), ("xmin", "ymin", "xmax", "ymax")
#: Fixed probes of the single-shape queries.
PX, PY, PS, PB, R = 300.0, 50.0, (100.0, 10.0, 400.0, 90.0), (200.0, 20.0, 400.0, 60.0), 40.0


#: Probes of the box queries, over the boxes of customers' orders: each is met by a part of them.
OX, OY, OB, OR = 150.0, 470.0, (0.0, 470.0, 150.0, 500.0), 20.0
#: Radius of the id-set queries.
NEAR = 3.0


def _boxed(s, d):
    return T.boxes(order_segments(s, d))


def _seg(column, name):
    return lambda s, d: event_segments(s, d).select("traj_id", "seg_id", F.round(column(), 6).alias(name))


def _flag(test):
    return lambda s, d: event_segments(s, d).where(test()).select("traj_id", "seg_id")


def _box(column, name):
    return lambda s, d: _boxed(s, d).select("traj_id", F.round(column(), 6).alias(name))


def _box_flag(test):
    return lambda s, d: _boxed(s, d).where(test()).select("traj_id")


def _knn(s, d, ties=False):
    g = event_segments(s, d).select("traj_id", "seg_id", *SEG)
    found = ranges.knn(g, lambda q: F.round(G.point_segment(PX, PY, q), 1 if ties else 6), 10, SEG, ties, ("traj_id", "seg_id"))
    return found.select("traj_id", "seg_id", "dist")


def _cells(s, d):
    """Sort-tile cells of trajectory boxes: 4 slabs by x, 4 tiles by y in each."""
    return layout.tiled(T.boxes(event_segments(s, d)), *layout.box_centre(), 4, 4)


def _summary(s, d):
    return T.summary(T.stats(event_segments(s, d)), ["n_segs", "total_length", "span"])


#: A closed ring for the polygon queries.
RING = [(100.0, 10.0), (500.0, 20.0), (450.0, 90.0), (250.0, 40.0), (120.0, 95.0), (100.0, 10.0)]


def _polygon(s, d):
    return event_points(s, d).where(shapes.polygon_contains(RING, "x", "y")).select("event_id")


def _knn_embedding(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet")
    return shapes.nearest_vectors(v, v.where("vec_id % 20 = 0"), 10)


def _estimate(s, d):
    """Selectivity of a box: overlap ratio of each trajectory's box weighted by its segments."""
    b = _boxed(s, d)
    return b.agg(F.round(F.sum(G.overlap_ratio(BOX, OB) * F.col("n_segs")) / F.sum("n_segs"), 6).alias("share"))


def _orders(s, d):
    return order_segments(s, d).groupBy("traj_id").agg(F.count("*").alias("n_segs"), F.round(F.min("x1"), 6).alias("first_x"))


def _ids(s, d):
    return event_segments(s, d).select("traj_id").distinct()


def _within(s, d):
    return event_segments(s, d).where(G.point_segment(PX, PY, SEG) <= NEAR).select("traj_id").distinct()


def _third(s, d):
    return _ids(s, d).where("traj_id % 3 = 0")


def _sets(op):
    return lambda s, d: idsets.members(op(idsets.of(_within(s, d)), idsets.of(_third(s, d))))


def _bloom_size(s, d):
    n = F.col("n")
    bits = F.ceil(-n * F.log(F.lit(0.1)) / F.pow(F.log(F.lit(2.0)), 2)).cast("long")
    return _ids(s, d).agg(F.count("*").alias("n")).select(bits.alias("bits")).select("bits", F.lit(idsets.bloom_hashes(10_000, idsets.bloom_bits(10_000, 0.1))).cast("long").alias("hashes"))


def _bloom(s, d):
    bits = idsets.bloom_bits(10_000, 0.1)
    return bits, idsets.bloom_seeds(idsets.bloom_hashes(10_000, bits))


def _bloom_probe(s, d):
    """Ids that were put are all found; those that weren't are found only by chance."""
    bits, seeds = _bloom(s, d)
    bloom = idsets.bloom_filter(_third(s, d), "traj_id", bits, seeds)
    found = idsets.may_contain(_ids(s, d), bloom, "traj_id", bits, seeds)
    return found.join(_third(s, d).withColumn("put", F.lit(True)), "traj_id", "left").where("put").select("traj_id")


def _sized_knn(s, d):
    """Boxes in order of distance until they hold 100 segments before them."""
    return ranges.knn_sized(_boxed(s, d), lambda b: G.point_mbr(1_200.0, 520.0, b), 100, "n_segs").select("traj_id", "dist")


def _zorder_decoded(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 64).alias("b"))
    return p.select("p_partkey", *[c.alias(n) for n, c in zip("ab", G.zorder_decode(G.zorder(["a", "b"], 6), 2, 6), strict=True)])


def queries() -> dict:
    from .suite_search import queries as more_queries

    return {
        "idset_intersection": _sets(idsets.intersection),
        "idset_union": _sets(idsets.union),
        "idset_difference": _sets(idsets.difference),
        "idset_complement": lambda s, d: idsets.members(idsets.complement(idsets.of(_within(s, d)), idsets.of(_ids(s, d)))),
        "idset_contains": lambda s, d: idsets.has(_ids(s, d), idsets.of(_within(s, d))),
        "idset_excludes": lambda s, d: idsets.has(_ids(s, d), idsets.of(_within(s, d)), anti=True),
        "bloom_may_contain": _bloom_probe,
        "zorder_decode": _zorder_decoded,
        "data_bounds": lambda s, d: T.boxes(event_segments(s, d)).agg(*[F.round((F.min if n.endswith("min") else F.max)(n), 6).alias(n) for n in BOX]),
        "dist_segment_circle": _seg(lambda: F.greatest(G.point_segment(PX, PY, SEG) - R, F.lit(0.0)), "dist"),
        "segment_measures": lambda s, d: event_segments(s, d).select("traj_id", "seg_id", F.round(G.point_point(*SEG), 6).alias("length"), F.round((F.col("x1") + F.col("x2")) / 2, 6).alias("cx"), F.round((F.col("y1") + F.col("y2")) / 2, 6).alias("cy")),
        "mbr_area": _box(lambda: (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), "area"),
        "point_dominates": lambda s, d: event_points(s, d).where((F.col("x") <= PX) & (F.col("y") <= PY)).select("event_id"),
        "span_percentiles": lambda s, d: T.stats(event_segments(s, d)).agg(*[F.round(F.percentile("span", F.lit(q)), 4).alias(n) for q, n in ((0.05, "p5"), (0.95, "p95"))]),
        "ranked_range": lambda s, d: _boxed(s, d).select("traj_id", F.round(G.point_mbr(OX, OY, BOX), 6).alias("dist")).where(F.col("dist") <= OR).orderBy("dist", "traj_id"),
        "polygon_contains": _polygon,
        "knn_embedding": _knn_embedding,
        "range_estimate": _estimate,
        "traj_orders": _orders,
        "idset_count": lambda s, d: idsets.count(idsets.of(_within(s, d))),
        "bloom_size": _bloom_size,
        "knn_point_sized": _sized_knn,
        "rdp_simplify": lambda s, d: shapes.simplified(event_points(s, d), "event_id", 5.0),
        "geojson_cells": lambda s, d: shapes.geojson(_cells(s, d).groupBy("cell").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")), "cell"),
        "traj_generate": lambda s, d: shapes.random_walks(s, 100),
        "bloom_filter": lambda s, d: idsets.bloom_filter(_ids(s, d), "traj_id", *_bloom(s, d)).select("bucket", F.bitmap_count("bits").alias("bits_set")),
        "dist_segment_mbr": _seg(lambda: G.segment_mbr(SEG, PB), "dist"),
        "segment_covers_mbr": _flag(lambda: G.segment_covers_mbr(SEG, PB, 150.0)),
        "traj_segments": lambda s, d: event_segments(s, d).select("traj_id", "seg_id", *[F.round(c, 6).alias(c) for c in SEG]),
        "traj_mbr": lambda s, d: T.boxes(event_segments(s, d)).select("traj_id", "n_segs", *[F.round(c, 6).alias(c) for c in BOX]),
        "traj_stats": lambda s, d: T.stats(event_segments(s, d)).select("traj_id", "n_segs", F.round("total_length", 4).alias("total_length"), F.round("span", 6).alias("span")),
        "traj_stats_summary": _summary,
        "traj_span_filter": lambda s, d: T.span_filter(event_segments(s, d), 0.001, 800.0, 20).groupBy("traj_id").agg(F.count("*").alias("n_segs")),
        "traj_relabel": lambda s, d: T.relabel(event_segments(s, d).select("traj_id")),
        "traj_sample": lambda s, d: T.sample(event_segments(s, d), 10).groupBy("traj_id").agg(F.count("*").alias("n_segs")),
        "dist_point_segment": _seg(lambda: G.point_segment(PX, PY, SEG), "dist"),
        "dist_segment_match": _seg(lambda: G.segment_match(SEG, PS), "dist"),
        "dist_segment_min": _seg(lambda: G.segment_min(SEG, PS), "dist"),
        "dist_point_mbr": _box(lambda: G.point_mbr(OX, OY, BOX), "dist"),
        "dist_point_mbr_max": _box(lambda: G.point_mbr_max(OX, OY, BOX), "dist"),
        "dist_mbr_mbr": _box(lambda: G.mbr_mbr(BOX, OB), "dist"),
        "dist_circle_mbr": _box(lambda: G.circle_mbr(OX, OY, OR, BOX), "dist"),
        "mbr_overlap_ratio": _box(lambda: G.overlap_ratio(BOX, OB), "ratio"),
        "mbr_contains": _box_flag(lambda: G.mbr_contains(BOX, OX, OY)),
        "mbr_intersects": _box_flag(lambda: G.mbr_intersects(BOX, OB)),
        "circle_intersects": _box_flag(lambda: G.point_mbr(OX, OY, BOX) <= OR),
        "seg_intersects_seg": _flag(lambda: G.segments_intersect(SEG, PS)),
        "range_mbr": _flag(lambda: G.segment_intersects_mbr(SEG, PB)),
        "circle_range": _flag(lambda: G.point_segment(PX, PY, SEG) <= R),
        "circle_range_conj": _flag(lambda: (G.point_segment(PX, PY, SEG) <= R) & (G.point_segment(PX + 20, PY, SEG) <= R)),
        "anti_circle_range": _flag(lambda: G.point_segment(PX, PY, SEG) > R),
        "ids_within": _within,
        "ids_prunable": lambda s, d: event_segments(s, d).where(G.point_segment(PX, PY, SEG) > 357.0).select("traj_id").distinct(),
        "knn_point": _knn,
        "knn_point_ties": lambda s, d: _knn(s, d, True),
        "str_cells": lambda s, d: _cells(s, d).select("traj_id", "cell"),
        "str_cell_stats": lambda s, d: _cells(s, d).groupBy("cell").agg(F.count("*").alias("n"), G.rounded(F.min("xmin")).alias("xmin"), G.rounded(F.max("ymax")).alias("ymax")),
        "haversine": lambda s, d: event_segments(s, d).select("traj_id", "seg_id", F.round(G.haversine(F.col("y1") / 10, F.col("x1") / 10, F.col("y2") / 10, F.col("x2") / 10) / 1000, 3).alias("km")),
        "zorder_encode": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 64).alias("b")).select("p_partkey", G.zorder(["a", "b"], 6).alias("z")),
    } | more_queries()


# --- SQL, written apart from the column expressions ----------------------------------------------

_WITH = """WITH pts AS (SELECT user_id AS traj_id, event_id, ts, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS x, CAST(value AS DOUBLE) AS y FROM events),
s0 AS (SELECT traj_id, row_number() OVER w - 1 AS seg_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY traj_id ORDER BY ts, event_id)),
seg AS (SELECT * FROM s0 WHERE x2 IS NOT NULL),
box AS (SELECT traj_id, count(*) AS n_segs, min(least(x1, x2)) AS xmin, min(least(y1, y2)) AS ymin, max(greatest(x1, x2)) AS xmax, max(greatest(y1, y2)) AS ymax FROM seg GROUP BY 1),
st AS (SELECT traj_id, any_value(n_segs) AS n_segs, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS total_length, any_value(sqrt((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin))) AS span FROM seg JOIN box USING (traj_id) GROUP BY 1)
"""


def _ps(px, py, a, b, c, d) -> str:
    t = f"(CASE WHEN {a} = {c} AND {b} = {d} THEN 0.0 ELSE greatest(0.0, least(1.0, (({px} - {a}) * ({c} - {a}) + ({py} - {b}) * ({d} - {b})) / (({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b})))) END)"
    return f"sqrt(pow({px} - ({a} + {t} * ({c} - {a})), 2) + pow({py} - ({b} + {t} * ({d} - {b})), 2))"


def _four(a, b) -> str:
    return ", ".join([_ps(a[0], a[1], *b), _ps(a[2], a[3], *b), _ps(b[0], b[1], *a), _ps(b[2], b[3], *a)])


def _turn(a, b, c) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def _cross(a, b) -> str:
    p, q, r, s = a[:2], a[2:], b[:2], b[2:]
    on = lambda u, v, w: f"({_turn(u, v, w)} = 0 AND {w[0]} BETWEEN least({u[0]}, {v[0]}) AND greatest({u[0]}, {v[0]}) AND {w[1]} BETWEEN least({u[1]}, {v[1]}) AND greatest({u[1]}, {v[1]}))"
    return f"(({_turn(p, q, r)} * {_turn(p, q, s)} < 0 AND {_turn(r, s, p)} * {_turn(r, s, q)} < 0) OR {on(p, q, r)} OR {on(p, q, s)} OR {on(r, s, p)} OR {on(r, s, q)})"


#: The same for customers' orders.
_ORDERS = """WITH pts AS (SELECT o_custkey AS traj_id, o_orderdate, o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) / 1000 AS y FROM orders),
s0 AS (SELECT traj_id, row_number() OVER w - 1 AS seg_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY traj_id ORDER BY o_orderdate, o_orderkey)),
""" + _WITH.split("\n", 2)[2]


def oracle_sql() -> dict:
    from .suite_search import oracle_sql as more_sql

    near, other = _ps(PX, PY, *SEG), _ps(PX + 20, PY, *SEG)
    point_box = lambda x, y: f"sqrt(pow(greatest(xmin - {x}, 0.0, {x} - xmax), 2) + pow(greatest(ymin - {y}, 0.0, {y} - ymax), 2))"
    pmbr, far = point_box(OX, OY), point_box(1_200.0, 520.0)
    x0, y0, x9, y9 = OB
    bmbr = f"sqrt(pow(greatest(xmin - {x9}, 0.0, {x0} - xmax), 2) + pow(greatest(ymin - {y9}, 0.0, {y0} - ymax), 2))"
    meets_box = f"xmin <= {x9} AND xmax >= {x0} AND ymin <= {y9} AND ymax >= {y0}"
    inside = f"{OX} BETWEEN xmin AND xmax AND {OY} BETWEEN ymin AND ymax"
    w, h = f"(least(xmax, {x9}) - greatest(xmin, {x0}))", f"(least(ymax, {y9}) - greatest(ymin, {y0}))"
    x0, y0, x9, y9 = PB
    in_box = " OR ".join([f"(x1 BETWEEN {x0} AND {x9} AND y1 BETWEEN {y0} AND {y9})", f"(x2 BETWEEN {x0} AND {x9} AND y2 BETWEEN {y0} AND {y9})", *[_cross(SEG, e) for e in ((x0, y0, x9, y0), (x9, y0, x9, y9), (x9, y9, x0, y9), (x0, y9, x0, y0))]])
    seg = lambda e, n: f"{_WITH} SELECT traj_id, seg_id, round({e}, 6) AS {n} FROM seg"
    flag = lambda e: f"{_WITH} SELECT traj_id, seg_id FROM seg WHERE {e}"
    box = lambda e, n: f"{_ORDERS} SELECT traj_id, round({e}, 6) AS {n} FROM box"
    box_flag = lambda e: f"{_ORDERS} SELECT traj_id FROM box WHERE {e}"
    rounded = lambda cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
    cells = f"""{_WITH}, c0 AS (SELECT *, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM box),
        c1 AS (SELECT *, len(list_filter((SELECT quantile_disc(cx, [0.25, 0.5, 0.75]) FROM c0), lambda v: v < cx)) AS slab FROM c0),
        q AS (SELECT slab, quantile_disc(cy, [0.25, 0.5, 0.75]) AS c FROM c1 GROUP BY slab),
        c2 AS (SELECT c1.*, c1.slab * 4 + len(list_filter(q.c, lambda v: v < cy)) AS cell FROM c1 JOIN q USING (slab))"""
    part = lambda c: f"SELECT '{c}' AS measure, round(avg({c}), 4) AS avg, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(stddev_pop({c}), 4) AS std, round(var_pop({c}), 4) AS var, round(CAST(median({c}) AS DOUBLE), 4) AS median, round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.95), 4) AS p95 FROM st"
    a = "(pow(sin(radians(y2 / 10 - y1 / 10) / 2), 2) + cos(radians(y1 / 10)) * cos(radians(y2 / 10)) * pow(sin(radians(x2 / 10 - x1 / 10) / 2), 2))"
    z = " + ".join(f"(((p_size >> {b}) & 1) << {2 * b + 1}) + ((((p_partkey % 64) >> {b}) & 1) << {2 * b})" for b in range(6))
    corners = [(x0, y0), (x9, y0), (x9, y9), (x0, y9)]
    sides = [(*a1, *b1) for a1, b1 in zip(corners, corners[1:] + corners[:1], strict=True)]
    rings = list(zip(RING, RING[1:]))
    on_ring = " OR ".join(f"({_turn(u, v, ('x', 'y'))} = 0 AND x BETWEEN least({u[0]}, {v[0]}) AND greatest({u[0]}, {v[0]}) AND y BETWEEN least({u[1]}, {v[1]}) AND greatest({u[1]}, {v[1]}))" for u, v in rings)
    odd = " + ".join(f"(CASE WHEN (y < {u[1]}) <> (y < {v[1]}) AND x < {u[0]} + (y - {u[1]}) * (({v[0]} - {u[0]}) / ({v[1]} - {u[1]})) THEN 1 ELSE 0 END)" for u, v in rings)
    within, third = f"SELECT traj_id FROM seg WHERE {near} <= {NEAR}", "SELECT traj_id FROM box WHERE traj_id % 3 = 0"
    ends = "POW(b.x - a.x, 2) + POW(b.y - a.y, 2)"
    along = f"CASE WHEN {ends} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ({ends}))) END"
    off = f"sqrt(pow(p.x - (a.x + ({along}) * (b.x - a.x)), 2) + pow(p.y - (a.y + ({along}) * (b.y - a.y)), 2))"
    ring = "[[round(xmin, 6), round(ymin, 6)], [round(xmax, 6), round(ymin, 6)], [round(xmax, 6), round(ymax, 6)], [round(xmin, 6), round(ymax, 6)], [round(xmin, 6), round(ymin, 6)]]"
    return {
        "idset_intersection": f"{_WITH} {within} INTERSECT {third}",
        "idset_union": f"{_WITH} {within} UNION {third}",
        "idset_difference": f"{_WITH} {within} EXCEPT {third}",
        "idset_complement": f"{_WITH} SELECT traj_id FROM box EXCEPT {within}",
        "idset_contains": f"{_WITH} SELECT DISTINCT traj_id FROM ({within})",
        "idset_excludes": f"{_WITH} SELECT traj_id FROM box EXCEPT {within}",
        "bloom_may_contain": f"{_WITH} {third}",
        "rdp_simplify": f"""{_WITH.replace("WITH", "WITH RECURSIVE", 1)}, p AS (SELECT traj_id, x, y, row_number() OVER (PARTITION BY traj_id ORDER BY event_id) - 1 AS i FROM pts),
            r AS (SELECT traj_id, 0::BIGINT AS lo, max(i) AS hi FROM p GROUP BY 1 UNION ALL
                  SELECT traj_id, unnest([lo, k]), unnest([k, hi]) FROM (SELECT r.traj_id, lo, hi, arg_max(p.i, (d, -p.i)) AS k, max(d) AS m FROM
                      (SELECT r.traj_id, r.lo, r.hi, p.i, {off} AS d FROM r JOIN p ON p.traj_id = r.traj_id AND p.i > r.lo AND p.i < r.hi JOIN p a ON a.traj_id = r.traj_id AND a.i = r.lo JOIN p b ON b.traj_id = r.traj_id AND b.i = r.hi) AS r JOIN p ON p.traj_id = r.traj_id AND p.i = r.i GROUP BY ALL) WHERE m > 5.0)
            SELECT traj_id, n_points, CASE WHEN n_points = 1 THEN 1 ELSE 2 + (count(*) - 1) // 2 END AS n_kept FROM r JOIN (SELECT traj_id, count(*) AS n_points FROM p GROUP BY 1) USING (traj_id) GROUP BY 1, 2""",
        "geojson_cells": f"""{cells} SELECT cell, '{{"type":"Polygon","coordinates":[' || replace(CAST({ring.replace("xmin", "min(xmin)").replace("xmax", "max(xmax)").replace("ymin", "min(ymin)").replace("ymax", "max(ymax)")} AS VARCHAR), ' ', '') || ']}}' AS geometry FROM c2 GROUP BY cell""",
        "zorder_decode": "SELECT p_partkey, CAST(p_size AS BIGINT) AS a, CAST(p_partkey % 64 AS BIGINT) AS b FROM part",
        "data_bounds": f"{_WITH} SELECT round(min(xmin), 6) AS xmin, round(min(ymin), 6) AS ymin, round(max(xmax), 6) AS xmax, round(max(ymax), 6) AS ymax FROM box",
        "dist_segment_circle": seg(f"greatest({near} - {R}, 0.0)", "dist"),
        "segment_measures": f"{_WITH} SELECT traj_id, seg_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM seg",
        "mbr_area": box("(xmax - xmin) * (ymax - ymin)", "area"),
        "point_dominates": f"{_WITH} SELECT event_id FROM pts WHERE x <= {PX} AND y <= {PY}",
        "span_percentiles": f"{_WITH} SELECT round(quantile_cont(span, 0.05), 4) AS p5, round(quantile_cont(span, 0.95), 4) AS p95 FROM st",
        "ranked_range": f"{_ORDERS} SELECT traj_id, round({pmbr}, 6) AS dist FROM box WHERE round({pmbr}, 6) <= {OR}",
        "polygon_contains": f"{_WITH} SELECT event_id FROM pts WHERE ({odd}) % 2 = 1 AND NOT ({on_ring})",
        "knn_embedding": "SELECT query_id, vec_id, dist FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS dist FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 10",
        "range_estimate": f"{_ORDERS} SELECT round(sum(n_segs * CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / ((xmax - xmin) * (ymax - ymin)) ELSE 0.0 END) / sum(n_segs), 6) AS share FROM box",
        "traj_orders": "WITH o AS (SELECT o_custkey AS traj_id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x FROM orders) SELECT traj_id, count(*) - 1 AS n_segs, round(min(x), 6) AS first_x FROM o GROUP BY 1 HAVING count(*) > 1",
        "idset_count": f"{_WITH} SELECT count(DISTINCT traj_id) AS n FROM ({within})",
        "bloom_size": f"{_WITH} SELECT CAST(ceil(-(SELECT count(*) FROM box) * ln(0.1) / pow(ln(2), 2)) AS BIGINT) AS bits, CAST(ceil(floor(ceil(-10000 * ln(0.1) / pow(ln(2), 2)) / 10000) * ln(2)) AS BIGINT) AS hashes",
        "knn_point_sized": f"{_ORDERS} SELECT traj_id, dist FROM (SELECT traj_id, dist, coalesce(sum(n_segs) OVER (ORDER BY dist, traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT traj_id, n_segs, round({far}, 6) AS dist FROM box)) WHERE b < 100",
        "dist_segment_mbr": seg(f"CASE WHEN {in_box} THEN 0.0 ELSE least({', '.join(_four(SEG, e) for e in sides)}) END", "dist"),
        "segment_covers_mbr": flag(f"greatest({', '.join(_ps(c[0], c[1], *SEG) for c in corners)}) <= 150.0"),
        "traj_segments": f"{_WITH} SELECT traj_id, seg_id, {rounded(SEG)} FROM seg",
        "traj_mbr": f"{_WITH} SELECT traj_id, n_segs, {rounded(BOX)} FROM box",
        "traj_stats": f"{_WITH} SELECT traj_id, n_segs, round(total_length, 4) AS total_length, round(span, 6) AS span FROM st",
        "traj_stats_summary": f"{_WITH} {part('n_segs')} UNION ALL {part('total_length')} UNION ALL {part('span')}",
        "traj_span_filter": f"{_WITH} SELECT traj_id, n_segs FROM st WHERE span > 0.001 AND span < 800.0 AND n_segs > 20",
        "traj_relabel": f"{_WITH} SELECT traj_id, row_number() OVER (ORDER BY traj_id) - 1 AS new_id FROM box",
        "traj_sample": f"{_WITH} SELECT traj_id, n_segs FROM box ORDER BY md5(CAST(traj_id AS VARCHAR)) LIMIT 10",
        "dist_point_segment": seg(near, "dist"),
        "dist_segment_match": seg(f"greatest({_four(SEG, PS)})", "dist"),
        "dist_segment_min": seg(f"CASE WHEN {_cross(SEG, PS)} THEN 0.0 ELSE least({_four(SEG, PS)}) END", "dist"),
        "dist_point_mbr": box(pmbr, "dist"),
        "dist_point_mbr_max": box(f"sqrt(pow(greatest(abs({OX} - xmin), abs({OX} - xmax)), 2) + pow(greatest(abs({OY} - ymin), abs({OY} - ymax)), 2))", "dist"),
        "dist_mbr_mbr": box(bmbr, "dist"),
        "dist_circle_mbr": box(f"greatest({pmbr} - {OR}, 0.0)", "dist"),
        "mbr_overlap_ratio": box(f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / ((xmax - xmin) * (ymax - ymin)) ELSE 0.0 END", "ratio"),
        "mbr_contains": box_flag(inside),
        "mbr_intersects": box_flag(meets_box),
        "circle_intersects": box_flag(f"{pmbr} <= {OR}"),
        "seg_intersects_seg": flag(_cross(SEG, PS)),
        "range_mbr": flag(in_box),
        "circle_range": flag(f"{near} <= {R}"),
        "circle_range_conj": flag(f"{near} <= {R} AND {other} <= {R}"),
        "anti_circle_range": flag(f"NOT ({near} <= {R})"),
        "ids_within": f"{_WITH} SELECT DISTINCT traj_id FROM seg WHERE {near} <= {NEAR}",
        "ids_prunable": f"{_WITH} SELECT traj_id FROM seg GROUP BY 1 HAVING max({near}) > 357.0",
        "knn_point": f"{_WITH} SELECT traj_id, seg_id, round({near}, 6) AS dist FROM seg ORDER BY dist, traj_id, seg_id LIMIT 10",
        "knn_point_ties": f"{_WITH} SELECT traj_id, seg_id, round({near}, 1) AS dist FROM seg QUALIFY rank() OVER (ORDER BY round({near}, 1)) <= 10",
        "str_cells": f"{cells} SELECT traj_id, cell FROM c2",
        "str_cell_stats": f"{cells} SELECT cell, count(*) AS n, round(min(xmin), 6) AS xmin, round(max(ymax), 6) AS ymax FROM c2 GROUP BY 1",
        "haversine": f"{_WITH} SELECT traj_id, seg_id, round(2 * 6371e3 * atan2(sqrt({a}), sqrt(1 - {a})) / 1000, 3) AS km FROM seg",
        "zorder_encode": f"SELECT p_partkey, {z} AS z FROM part",
    } | more_sql()
