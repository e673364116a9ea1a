"""Readers, writers, layouts, metric search, id sets, generators and streams."""

import random

import numpy as np
import pytest

from wayfold import storage
from wayfold.functions import kernels
from wayfold.functions.planar import Point, Polygon, polygon_of_wkb
from wayfold.operators import idsets, layout, metric, ranges, search, shapes
from wayfold.operators import trajectories as T
from wayfold.plans import strategies
from wayfold.sources import sinks
from wayfold.sources import trajectories as S
from wayfold.streaming import segments as streams

SEG = ("x1", "y1", "x2", "y2")


@pytest.fixture(scope="module")
def segments(spark):
    """Short trajectories far apart, so that pruning can leave some out; one of one segment, one of none."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        points = rng.uniform(0, 1_000, 2) + np.cumsum(rng.normal(0, 3, (rng.integers(2, 25), 2)), axis=0)
        rows += [(i, k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(points, points[1:]))]
    return spark.createDataFrame(rows, "traj_id long, seg_id int, x1 double, y1 double, x2 double, y2 double")


@pytest.fixture(scope="module")
def store(segments):
    return layout.Layout.build(segments, cells=25)


@pytest.fixture(scope="module")
def arrays(segments):
    out = {}
    for r in segments.orderBy("traj_id", "seg_id").collect():
        out.setdefault(r["traj_id"], []).append([r[c] for c in SEG])
    return {k: np.array(v) for k, v in out.items()}


def _nearest(arrays, query, k, distance):
    return sorted((round(distance(v, query), 6), i) for i, v in arrays.items())[:k]


@pytest.mark.parametrize("distance", ["hausdorff", "frechet"])
@pytest.mark.parametrize("strategy", strategies.STRATEGIES)
def test_strategies_agree_and_prune(store, arrays, strategy, distance):
    i = 17 if distance == "hausdorff" else 0
    rows = strategies.topk(store, arrays[i], 5, distance=distance, strategy=strategy).collect()
    assert [(r["dist"], r["traj_id"]) for r in rows] == _nearest(arrays, arrays[i], 5, kernels.DISTANCES[distance])
    if strategy != "scan" and distance == "hausdorff":
        seen = strategies.counted(store, arrays[i], 5, distance=distance, strategy=strategy)
        assert 5 <= seen["candidates"] < 100 and seen["cells_read"] < seen["cells"]


def test_search_edge_cases(store, arrays):
    """A query far outside, more neighbours than trajectories, a wrong name."""
    far = np.array([[1e6, 1e6, 1e6 + 1, 1e6]])
    assert [(r["dist"], r["traj_id"]) for r in strategies.topk(store, far, 3).collect()] == _nearest(arrays, far, 3, kernels.hausdorff)
    assert strategies.topk(store, arrays[0], 1_000).count() == len(arrays)
    with pytest.raises(ValueError):
        strategies.topk(store, far, 3, strategy="none")


def test_reading_prunes_folders(store):
    cell = store.cells()[0]["cell"]
    plan = store.segments([cell])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and store.segments([cell]).count() == store.cells()[0]["rows"]
    assert len(store.segments([cell]).inputFiles()) >= len([f for f in store.segments([cell]).inputFiles() if f"cell={cell}" in f]) > 0
    assert sum(c["rows"] for c in store.cells()) == store.segments().count()
    sizes = [c["rows"] for c in store.cells()]
    assert len(sizes) == 25 and max(sizes) < 3 * min(sizes) + 20


def test_many_queries(store, segments, arrays, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_SEGMENTS", 30)  # several blocks
    queries = segments.where("traj_id % 50 = 1")
    assert len(list(search.query_arrays(queries))) > 1
    got = {}
    for r in search.topk_many(store.trajectories(), queries, 4).collect():
        got.setdefault(r["query_id"], []).append((r["dist"], r["traj_id"]))
    assert {q: sorted(v) for q, v in got.items()} == {q: _nearest(arrays, arrays[q], 4, kernels.hausdorff) for q in arrays if q % 50 == 1}
    assert search.topk_many(store.trajectories(), queries.where("false")).count() == 0


def test_many_queries_measure_few(monkeypatch):
    """Overlapping trajectories: bounds leave out most of them, and the answer stays that of a scan."""
    rng, seen = np.random.default_rng(11), []
    segs = []
    for _ in range(600):
        points = np.stack([np.sort(rng.uniform(0, 720, 40)), rng.exponential(50, 40)], axis=1)
        segs.append(np.concatenate([points[:-1], points[1:]], axis=1))
    monkeypatch.setattr(search, "measured", lambda parts, *rest: seen.append(len(parts)) or kernels.measured(parts, *rest))
    points = np.concatenate([kernels.grid((0, 0), (720, 400), *size) for size in (search.COARSE, search.FINE)])
    for distance in ("hausdorff", "frechet", "points"):
        part = search._Part(segs, list(range(600)), points, distance)
        for q in (0, 5, 9):
            want = sorted((round(kernels.DISTANCES[distance](s, segs[q]), 6), i) for i, s in enumerate(segs))[:4]
            own = part.table[:, q] if distance != "points" else part.table[q]
            for bound in (np.inf, want[3][0]):
                rows = []
                seen.clear()
                part.search(segs[q], own, rows, 4, bound)
                assert rows == want
                assert distance == "points" or sum(seen) < 600 / (4 if bound == np.inf else 10)
    r = kernels.hausdorff(segs[1], segs[0])
    assert kernels.maybe_within(segs[1:2], segs[0], r + 1e-9).all() and not kernels.maybe_within(segs[1:2], segs[0], 1.0).any()


def test_vantage_tree(arrays):
    items = sorted(arrays.items())
    tree = metric.VantageTree(items, kernels.hausdorff)
    everything = _nearest(arrays, arrays[5], len(arrays), kernels.hausdorff)
    tree.checked = 0
    assert [(round(d, 6), i) for d, i in tree.nearest(arrays[5], 6)] == everything[:6] and tree.checked < len(items)
    within = everything[9][0] + 1e-6
    assert [(round(d, 6), i) for d, i in tree.nearest(arrays[5], 100, within)] == everything[:10]
    ranked = tree.ranked(arrays[5])
    assert [round(next(ranked)[0], 6) for _ in range(20)] == [d for d, _ in everything[:20]]
    assert [(round(d, 6), i) for d, i in tree.ranked(arrays[5], within)] == everything[:10]
    same = metric.VantageTree([(k, arrays[0]) for k in range(60)], kernels.hausdorff)
    assert [i for _, i in same.nearest(arrays[0], 3)] == [0, 1, 2]
    assert metric.VantageTree([], kernels.hausdorff).nearest(arrays[0], 3) == []


def test_memoised_distance(arrays):
    calls = []
    measure = kernels.memoised(lambda a, b: calls.append(1) or kernels.hausdorff(a, b), limit=3)
    one, two = (0, arrays[0]), (1, arrays[1])
    assert measure(one, two) == measure(two, one) == kernels.hausdorff(arrays[0], arrays[1]) and len(calls) == 1
    for k in range(2, 6):
        measure(one, (k, arrays[k]))
    assert measure(two, one) == kernels.hausdorff(arrays[0], arrays[1]) and len(calls) == 6


def test_distances_in_more_partitions(store, arrays):
    rows = search.trajectory_distances(store.trajectories(), arrays[0], partitions=7)
    assert rows.rdd.getNumPartitions() == 7 and rows.count() == len(arrays)


def test_metric_cells(store, arrays):
    cells = metric.MetricCells.build(store.trajectories(), 6)
    everything = _nearest(arrays, arrays[8], len(arrays), kernels.hausdorff)
    rows = lambda df: [(r["dist"], r["traj_id"]) for r in df.collect()]
    assert rows(cells.nearest(arrays[8], 7)) == everything[:7]
    assert rows(cells.within(arrays[8], everything[4][0] + 1e-5)) == everything[:5]
    assert rows(cells.nearest(arrays[8], 7, everything[2][0] + 1e-5)) == everything[:3]
    gone = store.trajectories().where("traj_id % 2 = 0")
    fewer = cells.remove(gone.select("traj_id"))
    assert rows(fewer.nearest(arrays[8], 5)) == [x for x in everything if x[1] % 2][:5]
    assert rows(fewer.insert(gone).nearest(arrays[8], 7)) == everything[:7]


def test_id_sets(spark):
    rnd = random.Random(1)
    a, b = ({rnd.randrange(-70_000, 140_000) for _ in range(3_000)} | {0, 1, -1, 32_768, 32_769, -32_768} for _ in range(2))
    df = lambda s: spark.createDataFrame([(i,) for i in s], "traj_id long")
    x, y = idsets.of(df(a)), idsets.of(df(b))
    ids = lambda s: {r["traj_id"] for r in idsets.members(s).collect()}
    assert ids(x) == a and ids(idsets.union(x, y)) == a | b and ids(idsets.intersection(x, y)) == a & b
    assert ids(idsets.difference(x, y)) == a - b and ids(idsets.complement(x, idsets.of(df(a | b)))) == b - a
    assert idsets.count(x).first()["n"] == len(a)
    assert {r["traj_id"] for r in idsets.has(df(b), x).collect()} == a & b
    assert {r["traj_id"] for r in idsets.has(df(b), x, anti=True).collect()} == b - a
    bits = idsets.bloom_bits(len(a), 0.1)
    seeds = idsets.bloom_seeds(idsets.bloom_hashes(len(a), bits))
    bloom = idsets.bloom_filter(df(a), "traj_id", bits, seeds)
    found = {r["traj_id"] for r in idsets.may_contain(df(a | b), bloom, "traj_id", bits, seeds).collect()}
    assert a <= found and len(found - a) < 0.25 * len(b - a)
    empty = idsets.of(df(a).where("false"))
    assert ids(idsets.difference(x, empty)) == a and idsets.count(empty).first()["n"] == 0


def test_text_round_trips(spark, segments, tmp_path):
    path = lambda n: f"{tmp_path}/{n}"
    sinks.write_segments(segments, path("tsv"))
    back = S.read_segments(spark, path("tsv"), min_partitions=9)
    assert back.rdd.getNumPartitions() >= 9
    key = lambda df: sorted(map(tuple, df.select("traj_id", "seg_id", *SEG).collect()))
    assert key(back) == key(segments) == key(S.read_queries(spark, path("tsv")))
    assert {r["traj_id"] for r in S.read_queries(spark, path("tsv"), 20).collect()} == set(range(20))
    (tmp_path / "one.tsv").write_text("9\t0\t0\t1\t1\n4\t1\t1\t2\t0\textra\n")
    one = S.read_single_query(spark, path("one.tsv"))
    assert search.query_array(one).tolist() == [[0, 0, 1, 1], [1, 1, 2, 0]]
    sinks.write_sample(T.sample(segments, 4), path("sample"))
    sample = S.read_segments(spark, path("sample"))
    assert len(sample.inputFiles()) == 1 and {r["traj_id"] for r in sample.collect()} == {0, 1, 2, 3}
    sinks.write_stats(T.stats(segments), path("stats"))
    lines = [r["value"].split("\t") for r in spark.read.text(path("stats")).collect()]
    assert sorted(int(x[0]) for x in lines) == sorted({r["traj_id"] for r in segments.collect()}) and all(len(x[3].split(".")[1]) == 6 for x in lines)


def test_point_lists_and_points(spark, tmp_path):
    (tmp_path / "lists.txt").write_text("7 0 0 1 1 2 0\n\n8 5 5\n9  1 2   3 4\n")
    rows = sorted(map(tuple, S.read_point_lists(spark, f"{tmp_path}/lists.txt").select("traj_id", "seg_id", *SEG).collect()))
    assert rows == [(7, 0, 0, 0, 1, 1), (7, 1, 1, 1, 2, 0), (9, 0, 1, 2, 3, 4)]
    (tmp_path / "points.tsv").write_text("a-0\t1.5\t2.5\na-0\t2.5\t3.5\nb-0\t0\t0\n")
    rows = S.points_to_segments(S.read_points(spark, f"{tmp_path}/points.tsv"), "place").collect()
    assert [(r["traj_id"], *[r[c] for c in SEG]) for r in rows] == [("a-0", 2.5, 1.5, 3.5, 2.5)]


def test_gpx(spark, tmp_path):
    track = lambda *segs: "<trk><name>n</name>" + "".join("<trkseg>" + "".join(f'<trkpt lat="{a}" lon="{b}"><ele>1</ele></trkpt>' for a, b in s) + "</trkseg>" for s in segs) + "</trk>"
    (tmp_path / "trace_000123456.gpx").write_text('<?xml version="1.0"?><gpx version="1.1">' + track([(1, 2), (3, 4)], [(5, 6)]) + track([(7, 8)]) + "</gpx>")
    rows = S.read_gpx(spark, f"{tmp_path}/trace_000123456.gpx").orderBy("traj_id", "place").collect()
    assert [(r["traj_id"], r["lat"], r["lon"]) for r in rows] == [("000123456-0", 1, 2), ("000123456-0", 3, 4), ("000123456-0", 5, 6), ("000123456-1", 7, 8)]


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    cases = {(2.0, 2.0): True, (0.0, 2.0): False, (4.0, 4.0): False, (5.0, 2.0): False, (2.0, 0.0): False, (-1.0, 0.0): False}
    table = spark.createDataFrame([(*k, v) for k, v in cases.items()], "x double, y double, want boolean")
    assert table.where(Polygon.of(ring).contains(Point("x", "y")) != table["want"]).count() == 0
    for wrong in ([(0, 0), (1, 1), (0, 0)], ring[:-1]):
        with pytest.raises(ValueError):
            Polygon.of(wrong)
    import struct

    big = struct.pack(">BIII", 0, 3, 1, 5) + np.array(ring, ">f8").tobytes()
    blobs = spark.createDataFrame([(1, bytearray(big)), (2, None)], "k int, wkb binary")
    got = {r["k"]: r["ring"] for r in blobs.select("k", polygon_of_wkb(blobs["wkb"]).alias("ring")).collect()}
    assert [(p["x"], p["y"]) for p in got[1]] == ring and got[2] is None


def test_relabel_strings(spark):
    ids = spark.createDataFrame([(f"t{k:04d}",) for k in range(1_000)] * 2, "traj_id string")
    rows = T.relabel(ids, 7).collect()
    assert sorted((r["traj_id"], r["new_id"]) for r in rows) == [(f"t{k:04d}", k) for k in range(1_000)]


def test_sample_rate(segments):
    some = T.sample_rate(segments, 0.3)
    n = some.select("traj_id").distinct().count()
    assert 30 <= n <= 90 and some.where("seg_id = 0").count() == n
    assert 0 < T.sample_rows(segments, 0.1).count() < segments.count()


def test_generators(spark):
    one, other = (sorted(map(tuple, shapes.random_walks(spark.newSession(), 20).repartition(n).collect())) for n in (1, 5))
    assert one == other and one[0][0] == 0
    stars = shapes.star_walks(spark, 20).collect()
    assert len({(r["traj_id"], r["x1"], r["y1"]) for r in stars}) == 20 and min(r["seg_id"] for r in stars) == 0
    steps = spark.range(4_000).select(shapes.normal(1, "id", mean=3.0, deviation=2.0).alias("v"), shapes.flip(0.95, 2, "id").alias("f"), shapes.uniform(3, "id", low=5.0, high=9.0).alias("u"))
    r = steps.selectExpr("avg(v) as m", "stddev(v) as s", "avg(f) as f", "min(u) as low", "max(u) as high").first()
    assert abs(r["m"] - 3) < 0.15 and abs(r["s"] - 2) < 0.15 and abs(r["f"] - 0.9) < 0.03 and 5 < r["low"] < 5.1 and 8.9 < r["high"] <= 9


def test_vectors_of_different_dimension(spark):
    table = spark.createDataFrame([([1.0, 2.0, 9.0], [1.0, 5.0])], "a array<double>, b array<double>")
    assert table.select(shapes.vector_distance(table["a"], table["b"])).first()[0] == 3.0


def test_observed_result(segments, arrays):
    result, seen = sinks.observed(search.distances(segments, arrays[0]), "search")
    rows = result.collect()
    assert seen.get["rows"] == len(rows) == len(arrays) and seen.get["farthest"] == max(r["dist"] for r in rows)


def test_range_or_scan_switches(store):
    from wayfold.functions import geometry as G

    box = (0.0, 0.0, 100.0, 100.0)
    test = G.segment_intersects_mbr(SEG, box)
    pruned, chosen = ranges.range_or_scan(store, box, test, 0.5, G.overlap_ratio)
    scanned, other = ranges.range_or_scan(store, box, test, -1.0, G.overlap_ratio)
    assert chosen and not other and sorted(map(tuple, pruned.collect())) == sorted(map(tuple, scanned.collect()))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        storage.shared_root(Session())


def test_stream_of_points(spark, tmp_path):
    """Segments of a stream in several batches equal those of the whole."""
    rnd = random.Random(2)
    points = [(k % 3, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", rnd.random(), rnd.random()) for k in range(60)]
    schema = "traj_id long, at timestamp, x double, y double"
    table = spark.createDataFrame(points, "traj_id long, at string, x double, y double").selectExpr("traj_id", "cast(at as timestamp) as at", "x", "y")
    for n in range(3):
        table.where(f"second(at) between {20 * n} and {20 * n + 19}").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.append_stream(streams.segments_of_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("traj_id", "seg_id", *SEG)
    want = S.points_to_segments(table, "at").select("traj_id", "seg_id", *SEG)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 57
    counts = streams.windowed_counts(table, "30 seconds", "1 minute").collect()
    assert sorted((r["points"], r["trajectories"]) for r in counts) == [(30, 3), (30, 3)]


def test_pairs_of_edges_are_kernels(spark):
    """No lambda in a lambda is left in the plan, and the kernels agree with the columns and with nulls."""
    from wayfold.functions import geometry as G
    from wayfold.functions.planar import Box, LineString, intersects, min_dist

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, (400, 4)).astype(float), rng.integers(0, 6, (400, 4)).astype(float)
    rows = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(a, b, strict=True)], "a1 double, a2 double, a3 double, a4 double, b1 double, b2 double, b3 double, b4 double")
    left, right = [f"a{k}" for k in (1, 2, 3, 4)], [f"b{k}" for k in (1, 2, 3, 4)]
    got = rows.select(G.segments_intersect(left, right).alias("meet"), G.segment_min(left, right).alias("dist")).collect()
    assert [r["meet"] for r in got] == (kernels.meeting(a, b) == 1).tolist() and [r["dist"] for r in got] == kernels.apart(a, b).tolist()
    na, nb = rng.integers(0, 5, 90), rng.integers(0, 5, 90)
    a, b = rng.random((na.sum(), 4)), rng.random((nb.sum(), 4))
    for pairs in (1, 7, 50_000):
        kernels.PAIRS = pairs
        got = kernels.row_pairs(a, na, b, nb, *kernels.PAIRED["apart"])
        for r, (i, j) in enumerate(zip(np.cumsum(na) - na, np.cumsum(nb) - nb, strict=True)):
            want = [kernels.apart(a[i + k : i + k + 1], b[j + m : j + m + 1])[0] for k in range(na[r]) for m in range(nb[r])]
            assert got[r] == min(want) if want else np.isnan(got[r])
    ring = Polygon.of([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])
    line = LineString.of([(1.0, 9.0), (1.0, 5.0)])
    points = spark.createDataFrame([(2.0,), (4.5,), (9.0,), (None,)], "x double")
    box = Box("x", "x", "x", "x")
    table = points.select(min_dist(ring, box).alias("d"), intersects(ring, box).alias("m"), min_dist(box, line).alias("l"), min_dist(ring, line).alias("r"), intersects(ring, line).alias("n"))
    out = [tuple(r) for r in table.collect()]
    assert [r[0] for r in out] == [0.0, pytest.approx(0.5**0.5), pytest.approx(50**0.5), None]
    assert [r[1] for r in out] == [True, False, False, None] and {r[3:] for r in out} == {(1.0, False)}
    assert [r[2] for r in out] == [pytest.approx(10**0.5), pytest.approx((3.5**2 + 0.5**2) ** 0.5), 8.0, None]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 0 and "ArrowEvalPython" in plan


def test_cells_are_cut_at_exact_quantiles(spark, monkeypatch):
    """Also where sketches are coarse, values repeat and a bracket misses its rank."""
    monkeypatch.setattr(layout, "ACCURACY", 20)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.exponential(10, 3_000), np.repeat([1.0, 7.0], 400), [5.0]])
    groups = np.concatenate([rng.integers(0, 3, 3_800), [9]])
    rows = spark.createDataFrame(list(zip(groups.tolist(), values.tolist(), strict=True)) + [(1, None)], "g int, v double").repartition(7)
    for parts in (4, 7):
        found = layout.quantiles(rows, "v", parts, "g")
        assert set(found) == {0, 1, 2, 9}
        for g, cuts in found.items():
            own = np.sort(values[groups == g])
            assert cuts == [own[-(-len(own) * k // parts) - 1] for k in range(1, parts)]
    assert layout.quantiles(rows.where("false"), "v", 4, "g") == {}


def test_numbers_as_in_sql(spark):
    """Halves of the seventh digit, small and large numbers, in texts and GeoJSON."""
    import duckdb

    from wayfold.functions import geometry as G

    values = [m / 3600000000.0 for m in range(1800, 40_000_000_000, 3_600 * 27_773)] + [2e-6, 0.000123, 0.00012, 0.5, 0.0, 12.0, 12345678.25, 1e7, 1.5e15, 1e16, 1.25e17, 0.0009, -3.5, -0.00002]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x double")
    got = rows.select("k", G.number_text(G.rounded("x")).alias("text"), Point("x", "x").text().alias("point"), G.rounded("x").alias("v")).orderBy("k").collect()
    con = duckdb.connect()
    want = [con.execute("SELECT CAST(round(x, 6) AS VARCHAR), 'POINT(' || printf('%.6f', round(x, 6)) || ' ' || printf('%.6f', round(x, 6)) || ')', round(x, 6) FROM (SELECT CAST(? AS DOUBLE) AS x)", [v]).fetchone() for v in values]
    assert [(r["text"], r["point"], r["v"]) for r in got] == want
    box = spark.createDataFrame([(1, 0.0003, 0.5, 1e7, 2.0)], "cell int, xmin double, ymin double, xmax double, ymax double")
    assert shapes.geojson(box, "cell").first()["geometry"] == '{"type":"Polygon","coordinates":[[[0.0003,0.5],[10000000.0,0.5],[10000000.0,2.0],[0.0003,2.0],[0.0003,0.5]]]}'
    assert sinks.geometry_collection(box, "cell").first()["geometry"].startswith('{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[[[0.0003,0.5],[0.0003,2.0],')
