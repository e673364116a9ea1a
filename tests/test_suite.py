"""Every registered trajectory query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from wayfold import suite

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def _key(row):
    return tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = suite.queries()[name](spark, DIR)
    want = db.execute(suite.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = sorted([tuple(r[c] for c in columns) for r in got.collect()], key=_key), sorted([tuple(r) for r in want.fetchall()], key=_key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == (pytest.approx(v, abs=2e-6) if isinstance(u, float) else v)


#: Flags and id sets, with the SQL of all rows that they choose from.
CHOSEN = {
    **dict.fromkeys(["mbr_contains", "mbr_intersects", "circle_intersects", "ranked_range", "range_boxes", "range_custom_distance"], "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1"),
    **dict.fromkeys(["ids_within", "idset_union", "idset_intersection", "idset_difference", "idset_complement", "idset_contains", "idset_excludes", "ids_prunable_any", "ids_within_any", "anti_join_ids", "bloom_may_contain"], "SELECT DISTINCT user_id FROM events"),
    **dict.fromkeys(["polygon_contains", "polygon_intersects_mbr", "polygon_intersects_circle", "line_intersects_circle", "circle_contains", "point_dominates", "pruned_range", "range_any_segment", "anti_range_any_segment", "circle_range", "seg_intersects_seg", "polygon_intersects_segment", "line_intersects_segment"], "SELECT event_id FROM events"),
}


@pytest.mark.parametrize("name", sorted(CHOSEN))
def test_a_filter_keeps_some(spark, db, name):
    """So that the comparison with SQL can tell."""
    share = suite.queries()[name](spark, DIR).count() / len(db.execute(CHOSEN[name]).fetchall())
    assert 0.02 <= share <= 0.98


@pytest.mark.parametrize("name", ["dist_point_mbr", "dist_mbr_mbr", "dist_circle_mbr", "dist_polygon_point", "dist_polygon_segment", "dist_line_segment", "dist_circle_circle", "dist_point_mbr_max", "knn_point_sized", "ranked_range", "mbr_overlap_ratio"])
def test_a_distance_has_many_values(spark, name):
    rows = suite.queries()[name](spark, DIR)
    column = [c for c in ("dist", "ratio") if c in rows.columns][0]
    assert rows.select(column).distinct().count() >= 5


def test_queries_without_sql(spark):
    q = suite.queries()
    assert set(q) - set(suite.oracle_sql()) == {"traj_generate", "traj_star_walks", "bloom_filter"}
    walks = q["traj_generate"](spark, DIR)
    sizes = walks.groupBy("traj_id").count()
    assert sizes.count() == 100 and sizes.agg({"count": "min"}).first()[0] > 12
    assert q["bloom_filter"](spark, DIR).agg({"bits_set": "sum"}).first()[0] <= 3 * 15


def test_kernels():
    import numpy as np

    from wayfold.functions import kernels

    rng = np.random.default_rng(0)
    a, b = rng.random((8, 4)), rng.random((5, 4))
    m = kernels.match_matrix(a, b)
    table = np.full((9, 6), np.inf)
    table[0, 0] = 0
    for i in range(8):
        for j in range(5):
            table[i + 1, j + 1] = max(m[i, j], min(table[i, j], table[i, j + 1], table[i + 1, j]))
    assert kernels.frechet(a, b) == table[-1, -1] >= kernels.hausdorff(a, b)
    parts = [rng.random((n, 4)) for n in (3, 1, 9, 40, 2)]
    for batch in (60_000, 100, 1):
        kernels.BATCH_CELLS = batch
        assert kernels.measured(parts, b, kernels.hausdorff).tolist() == pytest.approx([kernels.hausdorff(p, b) for p in parts])
    kernels.BATCH_CELLS = 60_000
    assert kernels.measured(parts, b, kernels.frechet).tolist() == [kernels.frechet(p, b) for p in parts] and len(kernels.measured([], b, kernels.hausdorff)) == 0
    cells, kernels.CELLS = kernels.CELLS, 7
    try:  # in blocks, and costs by diagonal
        assert kernels.frechet(a, b) == pytest.approx(table[-1, -1]) and kernels.hausdorff(a, b) == pytest.approx(max(m.min(1).max(), m.min(0).max()))
        assert kernels.directed(a, b) == pytest.approx(kernels.gap_matrix(a, b).min(1).max())
    finally:
        kernels.CELLS = cells
    assert kernels.hausdorff(a, b) == pytest.approx(kernels.hausdorff(b, a))
    assert kernels.hausdorff(a, a[::-1]) < 1e-12
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 2.0], [4, 0]])
    assert kernels.simplify(line, 0.1).tolist() == [0, 2, 3, 4]
