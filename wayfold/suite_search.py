"""Queries of stored layouts, searches by many strategies, polygons and line strings; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.planar import Box, Circle, LineString, Point, Polygon, Segment, intersects, min_dist, polygon_of_wkb, polygon_wkb
from .operators import idsets, layout, metric, ranges, search, trajectories as T
from .operators.shapes import star_walks
from .plans import strategies
from .sources import sinks
from .sources.trajectories import event_points, event_segments, order_segments, parse_point_list, points_to_segments

QUERY, MANY, CELLS, PIVOTS = 7, 20, 16, 8
SEG, BOX = layout.SEG, layout.BOX
#: Shapes of the polygon and line-string queries.
RING = [(100.0, 10.0), (500.0, 20.0), (450.0, 90.0), (250.0, 40.0), (120.0, 95.0), (100.0, 10.0)]
LINE = [(100.0, 100.0), (300.0, 30.0), (420.0, 120.0)]
NEAR, CIRCLE, WINDOW = 0.25, (300.0, 150.0, 30.0), (200.0, 60.0, 230.0, 130.0)


def store(s, d) -> layout.Layout:
    """The layout of the events' trajectories, built once a session and folder."""
    return layout.cached(("events", d), event_segments(s, d), CELLS)


def _query(s, d):
    return search.query_array(store(s, d).segments().where(F.col("traj_id") == QUERY).drop("cell"))


def _topk(distance, strategy):
    return lambda s, d: strategies.topk(store(s, d), _query(s, d), distance=distance, strategy=strategy)


_METRIC: dict = {}


def _cells(s, d, seed=0) -> metric.MetricCells:
    key = (s.sparkContext.applicationId, d)
    if key not in _METRIC:
        _METRIC[key] = metric.MetricCells.build(store(s, d).trajectories(), PIVOTS)
    return _METRIC[key]


def _changed(s, d):
    """The cells after every third trajectory was taken out and put in again."""
    some = store(s, d).trajectories().where("traj_id % 3 = 0")
    return _cells(s, d).remove(some.select("traj_id")).insert(some)


def _queries(s, d):
    return store(s, d).segments().where(F.col("traj_id") % MANY == 0).drop("cell")


def _first_queries(s, d):
    """The 3 first of all ids that are divisible by 20."""
    first = _queries(s, d).select("traj_id").distinct().orderBy("traj_id").limit(3)
    return search.topk_many(store(s, d).trajectories(), _queries(s, d).join(first, "traj_id", "left_semi"), 5)


def _any(s, d, anti=False):
    found = ranges.within_none if anti else ranges.within_any
    return found(store(s, d), _query(s, d), NEAR).select("traj_id", "seg_id")


def _prunable(s, d):
    return ranges.ids_beyond(store(s, d), _query(s, d), 24.0)


def _directed(s, d):
    g = store(s, d).segments()
    return g.groupBy("traj_id").agg(F.round(F.max(ranges.gap_to(_query(s, d))), 6).alias("dist"))


def _boxes(s, d):
    return T.boxes(order_segments(s, d))


def _query_boxes(s, d):
    rows = _boxes(s, d).where("traj_id % 500 = 4").select(*BOX).collect()  # a few probes
    import numpy as np

    return np.array([[r[n] for n in BOX] for r in rows], float).reshape(-1, 4) + np.array([[0.0, 300.0, -1_500.0, 300.0]])


def _events(s, d):
    return event_segments(s, d)


def _shape(test, shape):
    return lambda s, d: _events(s, d).where(test(Segment(*SEG), shape())).select("traj_id", "seg_id")


def _dist(shape):
    return lambda s, d: _events(s, d).select("traj_id", "seg_id", F.round(min_dist(Segment(*SEG), shape()), 6).alias("dist"))


def _points(test):
    return lambda s, d: event_points(s, d).where(test(Point("x", "y"))).select("event_id")


def _point_dist(shape):
    return lambda s, d: event_points(s, d).select("event_id", F.round(min_dist(Point("x", "y"), shape()), 6).alias("dist"))


def _small(make, value):
    """A small shape at each point of the events against a fixed one."""
    return lambda s, d: event_points(s, d).select("event_id", F.round(value(make()), 6).alias("dist") if value is not None else F.lit(None))


def _circle():
    return Circle("x", "y", 5.0)


def _square():
    return Box(F.col("x") - 4.0, F.col("y") - 4.0, F.col("x") + 4.0, F.col("y") + 4.0)


def _square_ring():
    x, y = F.col("x"), F.col("y")
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    return Polygon(F.array(*[corner(a, b) for a, b in ((-4.0, -4.0), (4.0, -4.0), (4.0, 4.0), (-4.0, 4.0), (-4.0, -4.0))]))


def _line_hausdorff(s, d):
    parts = F.sort_array(F.collect_list(F.struct("seg_id", *SEG)))
    rows = _events(s, d).where("seg_id < 5").groupBy("traj_id").agg(parts.alias("parts"))
    return rows.select("traj_id", F.round(LineString(F.col("parts")).hausdorff(LineString.of(LINE)), 6).alias("dist"))


def _texts(s, d):
    p, q = Point("x1", "y1"), Segment(*SEG)
    b, c = q.box(), Circle("x1", "y1", 2.0)
    return _events(s, d).select("traj_id", "seg_id", p.shifted(1.0).text().alias("point"), q.text().alias("segment"), b.text().alias("box"), c.box().text().alias("circle_box"))


def _wkb(s, d):
    """A ring of each segment's ends and (0, 0), to WKB and back, as text."""
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2"))], F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    rows = _events(s, d).select("traj_id", "seg_id", polygon_wkb(ring).alias("wkb"))
    return rows.select("traj_id", "seg_id", F.hex(F.substring("wkb", 1, 13)).alias("head"), Polygon(polygon_of_wkb(F.col("wkb"))).text().alias("polygon"))


def _point_lists(s, d):
    """Lines "id x0 y0 x1 y1 ..." of the orders' trajectories, parsed again."""
    g = order_segments(s, d)
    rows = T.assembled(g)
    ends = F.transform(F.sequence(F.lit(0), F.col("n_segs").cast("int") - 1), lambda k: F.concat_ws(" ", F.element_at("segs", 4 * k + 3).cast("string"), F.element_at("segs", 4 * k + 4).cast("string")))
    lines = rows.select(F.concat_ws(" ", F.col("traj_id").cast("string"), F.element_at("segs", 1).cast("string"), F.element_at("segs", 2).cast("string"), F.array_join(ends, " ")).alias("value"))
    each = lines.select(*parse_point_list(F.col("value"))).select("traj_id", F.posexplode("points").alias("place", "p")).select("traj_id", "place", "p.x", "p.y")
    return points_to_segments(each, "place").select("traj_id", "seg_id", *[F.round(c, 6).alias(c) for c in SEG])


def _runs(s, d):
    """Stretches of equal event types in a user's events."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("file"), "event_id", "ts", "event_type")
    r = T.runs(e.withColumn("at", F.struct("ts", "event_id")), "at", "event_type")
    return r.groupBy(F.col("file").alias("user_id"), "run").agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"))


def _cell_sets(s, d):
    """Trajectories of each cell, as the size of its set."""
    sets = store(s, d).table("cell_ids").groupBy("cell", F.bitmap_bucket_number("traj_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("traj_id")).alias("bits"))
    return sets.groupBy("cell").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _cells_union(s, d):
    """The union of the sets of the cells that meet the window."""
    at = store(s, d)
    near, _ = at.near_cells(_window(), 0.0)
    ids = at.table("cell_ids").where(F.col("cell").isin(near))
    sets = ids.groupBy("cell", F.bitmap_bucket_number("traj_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("traj_id")).alias("bits"))
    return idsets.members(idsets.union(sets.select("bucket", "bits")))


def _window():
    import numpy as np

    return np.array([WINDOW])


def _pruned_scan(s, d):
    return ranges.in_box(store(s, d), WINDOW, G.segment_intersects_mbr(SEG, WINDOW)).select("traj_id", "seg_id")


def _choice(s, d):
    return ranges.range_or_scan(store(s, d), WINDOW, G.segment_intersects_mbr(SEG, WINDOW), 0.5, G.overlap_ratio)[0].select("traj_id", "seg_id")


def _pivot_table(s, d):
    at = _cells(s, d)
    ids = F.array(*[F.lit(i) for i, _ in at.pivots])
    return at.members.select("traj_id", F.element_at(ids, F.col("pivot").cast("int") + 1).alias("pivot_id"), F.round("pivot_dist", 6).alias("dist"))


def _pivot_prefix(s, d):
    """Pivots by distance to the query until the cells before hold 40."""
    at = _cells(s, d)
    order = at._to_query(_query(s, d))
    rows = s.createDataFrame([(at.pivots[k][0], dist, at.cells[k][1]) for dist, k in order], "pivot_id long, dist double, size long")
    before = F.coalesce(F.sum("size").over(Window.orderBy("dist", "pivot_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where("before < 40").select("pivot_id", F.round("dist", 6).alias("dist"), "size")


def _anti(s, d):
    """Trajectories but for the prunable ones."""
    return store(s, d).trajectories().join(F.broadcast(_prunable(s, d)), "traj_id", "left_anti").select("traj_id", "n_segs")


def _segment_clusters(s, d):
    return sinks.geometry_collection(store(s, d).table("segment_cells"), "cell")


def _box_clusters(s, d):
    rows = layout.tiled(_boxes(s, d), *layout.box_centre(), 4, 4)
    return sinks.geometry_collection(rows.groupBy("cell").agg(*[(F.min if n.endswith("min") else F.max)(n).alias(n) for n in BOX]), "cell")


def _lines(s, d):
    return sinks.stats_lines(T.stats(event_segments(s, d))).orderBy("traj_id")


def _counters(s, d):
    """Candidates of two plans and all trajectories; the bound is the same."""
    rows = [(name, strategies.counted(store(s, d), _query(s, d), strategy=name)) for name in ("dual", "mbr")]
    return s.createDataFrame([(n, c["trajectories"], bool(10 <= c["candidates"] <= c["trajectories"]), bool(c["cells_read"] <= c["cells"])) for n, c in rows], "plan string, trajectories long, candidates_hold boolean, cells_hold boolean")


def queries() -> dict:
    far = lambda shape: lambda s: min_dist(s, shape())
    poly, line = lambda: Polygon.of(RING), lambda: LineString.of(LINE)
    found = {
        "dist_directed": _directed,
        "range_any_segment": _any,
        "anti_range_any_segment": lambda s, d: _any(s, d, True),
        "ids_within_any": lambda s, d: ranges.within_any(store(s, d), _query(s, d)[:2], NEAR).select("traj_id").distinct(),
        "ids_prunable_any": _prunable,
        "anti_join_ids": _anti,
        "segment_cells": lambda s, d: store(s, d).segments().select("traj_id", "seg_id", F.col("cell").cast("long").alias("cell")),
        "cell_boxes": lambda s, d: store(s, d).table("segment_cells").select(F.col("cell").cast("long").alias("cell"), "rows", *[G.rounded(n).alias(n) for n in BOX]),
        "cell_sets": lambda s, d: _cell_sets(s, d).select(F.col("cell").cast("long").alias("cell"), "n"),
        "cell_sets_union": _cells_union,
        "pruned_range": _pruned_scan,
        "range_or_scan": _choice,
        "range_custom_distance": lambda s, d: ranges.circle_range(_boxes(s, d), lambda b: G.point_mbr_max(1_200.0, 250.0, b), 1_200.0).select("traj_id"),
        "range_boxes": lambda s, d: ranges.boxes_within_any(_boxes(s, d).where("traj_id % 500 <> 4"), _query_boxes(s, d), 5.0).select("traj_id"),
        "knn_mbr": lambda s, d: ranges.knn(_boxes(s, d), lambda b: G.mbr_mbr(b, (1_190.0, 505.0, 1_210.0, 510.0)), 10).select("traj_id", "dist"),
        "knn_mbr_ties": lambda s, d: ranges.knn(_boxes(s, d), lambda b: F.round(G.mbr_mbr(b, (1_190.0, 500.5, 1_210.0, 510.0)), 0), 10, keep_same=True).select("traj_id", "dist"),
        "pivot_assignment": _pivot_table,
        "pivot_radius": lambda s, d: _pivot_table(s, d).groupBy("pivot_id").agg(F.max("dist").alias("radius"), F.count("*").alias("size")),
        "pivot_prefix": _pivot_prefix,
        "metric_range": lambda s, d: _cells(s, d).within(_query(s, d), 40.0),
        "metric_nearest_within": lambda s, d: _cells(s, d).nearest(_query(s, d), 10, 40.0),
        "metric_insert_remove": lambda s, d: _changed(s, d).nearest(_query(s, d), 10),
        "topk_many": lambda s, d: search.topk_many(store(s, d).trajectories(), _queries(s, d)),
        "topk_first_queries": _first_queries,
        "topk_points": _topk("points", "scan"),
        "topk_hausdorff_raw": lambda s, d: search.topk(event_segments(s, d), event_segments(s, d).where(F.col("traj_id") == QUERY)),
        "topk_hausdorff": _topk("hausdorff", "scan"),
        "topk_frechet": _topk("frechet", "scan"),
        "topk_hausdorff_pruned": _topk("hausdorff", "dual"),
        "topk_frechet_pruned": _topk("frechet", "dual"),
        "topk_hausdorff_pivot": lambda s, d: strategies.topk_cells(_cells(s, d), _query(s, d)),
        "topk_hausdorff_tree": lambda s, d: metric.tree_topk(store(s, d).trajectories(), _query(s, d), 10),
        "plan_counters": _counters,
        "traj_sample_rate": lambda s, d: T.sample_rate(event_segments(s, d), 0.25).select("traj_id", "seg_id", *[F.round(c, 6).alias(c) for c in SEG]),
        "traj_runs": _runs,
        "traj_assembled": lambda s, d: T.exploded(T.assembled(event_segments(s, d))).select("traj_id", "seg_id", *[F.round(c, 6).alias(c) for c in SEG]),
        "traj_star_walks": lambda s, d: star_walks(s, 100).groupBy("traj_id").agg(F.count("*").alias("n_segs")),
        "point_lists": _point_lists,
        "stats_lines": _lines,
        "shape_texts": _texts,
        "polygon_wkb": _wkb,
        "geojson_collection": _box_clusters,
        "geojson_segment_cells": _segment_clusters,
        "point_equals": lambda s, d: s.read.parquet(f"{d}/part.parquet").where(Point(F.col("p_partkey") % 4, F.col("p_size") % 3).equals(Point(1.0, 2.0))).select("p_partkey"),
        "circle_contains": _points(lambda p: Circle(300.0, 50.0, 60.0).contains(p)),
        "circle_intersects_circle": _points(lambda p: intersects(_circle(), Circle(*CIRCLE))),
        "polygon_intersects_segment": _shape(intersects, poly),
        "polygon_intersects_mbr": _points(lambda p: intersects(poly(), _square())),
        "polygon_intersects_circle": _points(lambda p: intersects(poly(), _circle())),
        "polygon_intersects_polygon": _points(lambda p: intersects(poly(), _square_ring())),
        "line_intersects_segment": _shape(intersects, line),
        "line_intersects_circle": _points(lambda p: intersects(line(), _circle())),
        "dist_polygon_point": _point_dist(poly),
        "dist_polygon_segment": _dist(poly),
        "dist_polygon_mbr": _small(_square, far(poly)),
        "dist_polygon_circle": _small(_circle, far(poly)),
        "dist_polygon_polygon": _small(_square_ring, far(poly)),
        "dist_line_segment": _dist(line),
        "dist_line_point": _point_dist(line),
        "dist_circle_point": _point_dist(lambda: Circle(*CIRCLE)),
        "dist_circle_circle": _small(_circle, far(lambda: Circle(*CIRCLE))),
        "line_hausdorff": _line_hausdorff,
    }
    for strategy in strategies.STRATEGIES:
        for distance in ("hausdorff", "frechet"):
            if strategy not in ("scan", "dual"):
                found[f"topk_{distance}_{strategy}"] = _topk(distance, strategy)
    return found


# --- SQL ---------------------------------------------------------------------------------------


def oracle_sql() -> dict:
    from .suite import _ORDERS, _WITH, _cross, _four, _ps

    t, q = tuple(f"t.{c}" for c in SEG), tuple(f"q.{c}" for c in SEG)
    match, meets, least = f"greatest({_four(t, q)})", _cross(t, q), f"least({_four(t, q)})"
    gap = f"CASE WHEN {meets} THEN 0.0 ELSE {least} END"
    one = f"(SELECT * FROM seg WHERE traj_id = {QUERY})"
    pairs = lambda cost, where=f"traj_id = {QUERY}": f"{_WITH}, pr AS (SELECT t.traj_id AS tid, t.seg_id AS sid, q.traj_id AS qt, q.seg_id AS qid, {cost} AS c FROM seg t CROSS JOIN (SELECT * FROM seg WHERE {where}) q)"
    sides = "SELECT qt, tid, min(c) AS a, NULL AS b FROM pr GROUP BY qt, tid, sid UNION ALL SELECT qt, tid, NULL, min(c) FROM pr GROUP BY qt, tid, qid"
    dists = lambda how: f"SELECT qt, tid AS traj_id, round({how}(max(a), max(b)), 6) AS dist FROM ({sides}) GROUP BY qt, tid"
    haus = f"{pairs(match)} SELECT traj_id, dist FROM ({dists('greatest')}) ORDER BY dist, traj_id LIMIT 10"
    fre = f"{pairs(match)}, m AS (SELECT tid, list(r ORDER BY sid) AS m FROM (SELECT tid, sid, list(c ORDER BY qid) AS r FROM pr GROUP BY 1, 2) GROUP BY 1), f AS (SELECT tid AS traj_id, round(list_reduce(m, lambda prev, row: list_reduce(range(1, len(row) + 1), lambda acc, j: acc || [greatest(row[j], least(acc[j - 1], prev[j], prev[j - 1]))], cast([] AS double[])), cast([] AS double[]))[-1], 6) AS dist FROM m) SELECT traj_id, dist FROM f ORDER BY dist, traj_id LIMIT 10"
    many = lambda where, k: f"{pairs(match, where)} SELECT qt AS query_id, traj_id, dist FROM ({dists('greatest')}) QUALIFY row_number() OVER (PARTITION BY qt ORDER BY dist, traj_id) <= {k}"
    near_any = lambda r: f"EXISTS (SELECT 1 FROM {one} q WHERE {gap} <= {r})"
    beyond = f"SELECT DISTINCT traj_id FROM seg t WHERE NOT {near_any(24.0)}"
    pivots = f"(SELECT traj_id FROM box ORDER BY md5(CAST(traj_id AS VARCHAR)) LIMIT {PIVOTS})"
    piv = f"{pairs(match, f'traj_id IN {pivots}')}, pd AS (SELECT qt AS pivot_id, traj_id, dist FROM ({dists('greatest')})), pa AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY dist, md5(CAST(pivot_id AS VARCHAR))) = 1)"
    by = lambda c, rows, also="": f"quantile_disc({c}, [0.25, 0.5, 0.75]) FROM {rows}{also}"
    tiles = lambda w, rows, cx, cy: f"{w}, c0 AS (SELECT *, {cx} AS cx, {cy} AS cy FROM {rows}), c1 AS (SELECT *, len(list_filter((SELECT {by('cx', 'c0')}), lambda v: v < cx)) AS slab FROM c0), cq AS (SELECT slab, quantile_disc(cy, [0.25, 0.5, 0.75]) AS c FROM c1 GROUP BY slab), c2 AS (SELECT c1.*, c1.slab * 4 + len(list_filter(cq.c, lambda v: v < cy)) AS cell FROM c1 JOIN cq USING (slab))"
    scells = tiles(_WITH, "seg", "(x1 + x2) / 2", "(y1 + y2) / 2") + ", cb AS (SELECT cell, count(*) AS n, min(least(x1, x2)) AS xmin, min(least(y1, y2)) AS ymin, max(greatest(x1, x2)) AS xmax, max(greatest(y1, y2)) AS ymax FROM c2 GROUP BY 1)"
    bcells = tiles(_ORDERS, "box", "(xmin + xmax) / 2", "(ymin + ymax) / 2") + ", cb AS (SELECT cell, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM c2 GROUP BY 1)"
    x0, y0, x9, y9 = WINDOW
    edges = lambda b: ((b[0], b[1], b[2], b[1]), (b[2], b[1], b[2], b[3]), (b[2], b[3], b[0], b[3]), (b[0], b[3], b[0], b[1]))
    in_box = " OR ".join([f"(x1 BETWEEN {x0} AND {x9} AND y1 BETWEEN {y0} AND {y9})", f"(x2 BETWEEN {x0} AND {x9} AND y2 BETWEEN {y0} AND {y9})", *[_cross(SEG, e) for e in edges(WINDOW)]])
    ring = list(zip(RING, RING[1:]))
    ring_edges, line_edges = [(*a, *b) for a, b in ring], [(*a, *b) for a, b in zip(LINE, LINE[1:])]
    holds = lambda x, y: "((" + " + ".join(f"(CASE WHEN ({y} < {u[1]}) <> ({y} < {v[1]}) AND {x} < {u[0]} + ({y} - {u[1]}) * (({v[0]} - {u[0]}) / ({v[1]} - {u[1]})) THEN 1 ELSE 0 END)" for u, v in ring) + ") % 2 = 1)"
    own = lambda e, edges_: " OR ".join(_cross(e, x) for x in edges_)
    apart = lambda e, edges_: f"least({', '.join(_four_of(e, x) for x in edges_)})"
    _four_of = lambda e, x: _four(e, x)
    to = lambda x, y, edges_: f"least({', '.join(_ps(x, y, *e) for e in edges_)})"
    square = ("(x - 4.0)", "(y - 4.0)", "(x + 4.0)", "(y + 4.0)")
    sq_edges = edges(square)
    sq_meets = " OR ".join([*[_cross(a, b) for a in sq_edges for b in ring_edges], holds(square[0], square[1]), f"({RING[0][0]} BETWEEN {square[0]} AND {square[2]} AND {RING[0][1]} BETWEEN {square[1]} AND {square[3]})"])
    sq_apart = f"CASE WHEN {sq_meets} THEN 0.0 ELSE least({', '.join(_four(a, b) for a in sq_edges for b in ring_edges)}) END"
    poly_point = f"CASE WHEN {holds('x', 'y')} THEN 0.0 ELSE {to('x', 'y', ring_edges)} END"
    poly_meets = f"{holds('x1', 'y1')} OR {own(SEG, ring_edges)}"
    seg = lambda e: f"{_WITH} SELECT traj_id, seg_id, round({e}, 6) AS dist FROM seg"
    flag = lambda e: f"{_WITH} SELECT traj_id, seg_id FROM seg WHERE {e}"
    pt = lambda e: f"{_WITH} SELECT event_id, round({e}, 6) AS dist FROM pts"
    ptf = lambda e: f"{_WITH} SELECT event_id FROM pts WHERE {e}"
    centre = lambda x, y: f"sqrt(pow(x - {x}, 2) + pow(y - {y}, 2))"
    cx, cy, cr = CIRCLE
    rounded = lambda cs, p="": ", ".join(f"round({p}{c}, 6) AS {c}" for c in cs)
    mm = lambda b: f"sqrt(pow(greatest(xmin - {b[2]}, 0.0, {b[0]} - xmax), 2) + pow(greatest(ymin - {b[3]}, 0.0, {b[1]} - ymax), 2))"
    digits = lambda *cs: " || ' ' || ".join(f"printf('%.6f', round({c}, 6))" for c in cs)
    closed = lambda b: "[" + ", ".join(f"[round({x}, 6), round({y}, 6)]" for x, y in (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin"))) + "]"
    collection = lambda cells: f"""{cells} SELECT '{{"type":"GeometryCollection","geometries":[' || string_agg('{{"type":"Polygon","coordinates":[' || replace(CAST({closed('')} AS VARCHAR), ' ', '') || ']}}', ',' ORDER BY cell) || ']}}' AS geometry FROM cb"""
    lh = " UNION ALL ".join(f"SELECT traj_id, seg_id, {k} AS part, CASE WHEN {_cross(SEG, e)} THEN 0.0 ELSE least({_four(SEG, e)}) END AS g FROM seg WHERE seg_id < 5" for k, e in enumerate(line_edges))
    points = f"{pairs(gap)} SELECT traj_id, dist FROM ({dists('least')}) ORDER BY dist, traj_id LIMIT 10"
    found = {
        "dist_directed": f"{_WITH} SELECT traj_id, round(max(dist), 6) AS dist FROM (SELECT t.traj_id, t.seg_id, min({gap}) AS dist FROM seg t CROSS JOIN {one} q GROUP BY 1, 2) GROUP BY 1",
        "range_any_segment": f"{_WITH} SELECT traj_id, seg_id FROM seg t WHERE {near_any(NEAR)}",
        "anti_range_any_segment": f"{_WITH} SELECT traj_id, seg_id FROM seg t WHERE NOT {near_any(NEAR)}",
        "ids_within_any": f"{_WITH} SELECT DISTINCT traj_id FROM seg t WHERE EXISTS (SELECT 1 FROM {one} q WHERE q.seg_id < 2 AND {gap} <= {NEAR})",
        "ids_prunable_any": f"{_WITH} {beyond}",
        "anti_join_ids": f"{_WITH} SELECT traj_id, n_segs FROM box WHERE traj_id NOT IN ({beyond})",
        "segment_cells": f"{scells} SELECT traj_id, seg_id, cell FROM c2",
        "cell_boxes": f"{scells} SELECT cell, n AS rows, {rounded(BOX)} FROM cb",
        "cell_sets": f"{scells} SELECT cell, count(DISTINCT traj_id) AS n FROM c2 GROUP BY 1",
        "cell_sets_union": f"{scells} SELECT DISTINCT traj_id FROM c2 JOIN cb USING (cell) WHERE xmin <= {x9} AND xmax >= {x0} AND ymin <= {y9} AND ymax >= {y0}",
        "pruned_range": flag(in_box),
        "range_or_scan": flag(in_box),
        "range_custom_distance": f"{_ORDERS} SELECT traj_id FROM box WHERE sqrt(pow(greatest(abs(1200.0 - xmin), abs(1200.0 - xmax)), 2) + pow(greatest(abs(250.0 - ymin), abs(250.0 - ymax)), 2)) <= 1200.0",
        "range_boxes": f"{_ORDERS} SELECT traj_id FROM box b WHERE traj_id % 500 <> 4 AND EXISTS (SELECT 1 FROM box q WHERE q.traj_id % 500 = 4 AND sqrt(pow(greatest(b.xmin - greatest(q.xmin, q.xmax - 1500), 0, least(q.xmin, q.xmax - 1500) - b.xmax), 2) + pow(greatest(b.ymin - (q.ymax + 300), 0, q.ymin + 300 - b.ymax), 2)) <= 5.0)",
        "knn_mbr": f"{_ORDERS} SELECT traj_id, round({mm((1190.0, 505.0, 1210.0, 510.0))}, 6) AS dist FROM box ORDER BY dist, traj_id LIMIT 10",
        "knn_mbr_ties": f"{_ORDERS} SELECT traj_id, round({mm((1190.0, 500.5, 1210.0, 510.0))}) AS dist FROM box QUALIFY rank() OVER (ORDER BY round({mm((1190.0, 500.5, 1210.0, 510.0))})) <= 10",
        "pivot_assignment": f"{piv} SELECT traj_id, pivot_id, dist FROM pa",
        "pivot_radius": f"{piv} SELECT pivot_id, max(dist) AS radius, count(*) AS size FROM pa GROUP BY 1",
        "pivot_prefix": f"{piv} SELECT pivot_id, dist, size FROM (SELECT pivot_id, dist, size, coalesce(sum(size) OVER (ORDER BY dist, pivot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT pivot_id, dist FROM pd WHERE traj_id = {QUERY}) JOIN (SELECT pivot_id, count(*) AS size FROM pa GROUP BY 1) USING (pivot_id)) WHERE b < 40",
        "metric_range": f"{pairs(match)} SELECT traj_id, dist FROM ({dists('greatest')}) WHERE dist <= 40.0",
        "metric_nearest_within": f"{pairs(match)} SELECT traj_id, dist FROM ({dists('greatest')}) WHERE dist <= 40.0 ORDER BY dist, traj_id LIMIT 10",
        "metric_insert_remove": haus,
        "topk_many": many(f"traj_id % {MANY} = 0", 10),
        "topk_first_queries": many(f"traj_id IN (SELECT traj_id FROM box WHERE traj_id % {MANY} = 0 ORDER BY 1 LIMIT 3)", 5),
        "topk_points": points,
        "plan_counters": f"{_WITH} SELECT plan, (SELECT count(*) FROM box) AS trajectories, true AS candidates_hold, true AS cells_hold FROM (VALUES ('dual'), ('mbr')) v(plan)",
        "traj_sample_rate": f"{_WITH} SELECT traj_id, seg_id, {rounded(SEG)} FROM seg WHERE substr(md5(CAST(traj_id AS VARCHAR)), 1, 8) < '{int(0.25 * 2**32):08x}'",
        "traj_runs": "WITH a AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_type) AS event_type FROM b GROUP BY 1, 2",
        "traj_assembled": f"{_WITH} SELECT traj_id, seg_id, {rounded(SEG)} FROM seg",
        "point_lists": f"{_ORDERS} SELECT traj_id, seg_id, {rounded(SEG)} FROM seg",
        "stats_lines": f"{_WITH} SELECT traj_id, traj_id || chr(9) || n_segs || chr(9) || printf('%.6f', round(total_length, 6)) || chr(9) || printf('%.6f', round(span, 6)) AS line FROM st",
        "shape_texts": f"{_WITH} SELECT traj_id, seg_id, 'POINT(' || {digits('x1 + 1', 'y1 + 1')} || ')' AS point, 'SEG(' || {digits('x1', 'y1')} || '->' || {digits('x2', 'y2')} || ')' AS segment, 'MBR(' || {digits('least(x1, x2)', 'least(y1, y2)')} || ',' || {digits('greatest(x1, x2)', 'greatest(y1, y2)')} || ')' AS box, 'MBR(' || {digits('x1 - 2', 'y1 - 2')} || ',' || {digits('x1 + 2', 'y1 + 2')} || ')' AS circle_box FROM seg",
        "polygon_wkb": f"{_WITH} SELECT traj_id, seg_id, '01030000000100000004000000' AS head, 'POLYGON((' || {digits('x1', 'y1')} || ', ' || {digits('x2', 'y2')} || ', ' || {digits('0.0', '0.0')} || ', ' || {digits('x1', 'y1')} || '))' AS polygon FROM seg",
        "geojson_collection": collection(bcells),
        "geojson_segment_cells": collection(scells),
        "point_equals": "SELECT p_partkey FROM part WHERE p_partkey % 4 = 1 AND p_size % 3 = 2",
        "circle_contains": ptf(f"{centre(300.0, 50.0)} <= 60.0"),
        "circle_intersects_circle": ptf(f"{centre(cx, cy)} <= {cr + 5.0}"),
        "polygon_intersects_segment": flag(poly_meets),
        "polygon_intersects_mbr": ptf(sq_meets),
        "polygon_intersects_circle": ptf(f"{poly_point} <= 5.0"),
        "polygon_intersects_polygon": ptf(sq_meets),
        "line_intersects_segment": flag(own(SEG, line_edges)),
        "line_intersects_circle": ptf(f"{to('x', 'y', line_edges)} <= 5.0"),
        "dist_polygon_point": pt(poly_point),
        "dist_polygon_segment": seg(f"CASE WHEN {poly_meets} THEN 0.0 ELSE {apart(SEG, ring_edges)} END"),
        "dist_polygon_mbr": pt(sq_apart),
        "dist_polygon_circle": pt(f"greatest({poly_point} - 5.0, 0.0)"),
        "dist_polygon_polygon": pt(sq_apart),
        "dist_line_segment": seg(f"CASE WHEN {own(SEG, line_edges)} THEN 0.0 ELSE {apart(SEG, line_edges)} END"),
        "dist_line_point": pt(to("x", "y", line_edges)),
        "dist_circle_point": pt(f"greatest({centre(cx, cy)} - {cr}, 0.0)"),
        "dist_circle_circle": pt(f"greatest({centre(cx, cy)} - {cr} - 5.0, 0.0)"),
        "line_hausdorff": f"{_WITH}, g AS ({lh}) SELECT traj_id, round(greatest(max(a), max(b)), 6) AS dist FROM (SELECT traj_id, min(g) AS a, NULL AS b FROM g GROUP BY traj_id, seg_id UNION ALL SELECT traj_id, NULL, min(g) FROM g GROUP BY traj_id, part) GROUP BY 1",
        **{f"topk_hausdorff_{x}": haus for x in ("raw", "pruned", "pivot", "tree")},
        "topk_hausdorff": haus, "topk_frechet": fre, "topk_frechet_pruned": fre,
    }
    for strategy in strategies.STRATEGIES:
        if strategy not in ("scan", "dual"):
            found |= {f"topk_hausdorff_{strategy}": haus, f"topk_frechet_{strategy}": fre}
    return found
