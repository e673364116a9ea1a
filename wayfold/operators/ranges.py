"""Range and nearest-neighbour searches over segments and boxes, against one shape or the segments of a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import CELLS, box_gaps, gap_matrix
from .layout import BOX, SEG, Layout


def gap_to(query: np.ndarray, most: float = float("inf")) -> Column:
    """Least distance of a row's segment to any of the query's; where it is over ``most`` it may be infinity."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def gap(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = np.stack([x.to_numpy() for x in (a, b, c, d)], axis=1)
        out = np.full(len(rows), np.inf)
        step = max(1, CELLS // 256)
        for k in range(0, len(query), 256):
            part = query[k : k + 256]
            for j in range(0, len(rows), step):
                some = rows[j : j + step]
                near = np.flatnonzero((box_gaps(some, part) <= most).any(1)) if most < np.inf else np.arange(len(some))
                if len(near):
                    out[j + near] = np.minimum(out[j + near], gap_matrix(some[near], part).min(1))
        return pa.array(out)

    return gap(*SEG)


def within_any(store: Layout, query: np.ndarray, radius: float) -> DataFrame:
    """Segments within ``radius`` of any of the query's; only cells that near are read."""
    near, _ = store.near_cells(query, radius)
    return store.segments(near).where(gap_to(query, radius) <= radius)


def within_none(store: Layout, query: np.ndarray, radius: float) -> DataFrame:
    """Segments farther than ``radius`` from all of the query's; far cells need no distance."""
    near, far = store.near_cells(query, radius)
    return store.segments(far).unionByName(store.segments(near).where(gap_to(query, radius) > radius))


def ids_beyond(store: Layout, query: np.ndarray, radius: float) -> DataFrame:
    """traj_id of those with a segment farther than ``radius`` from all of the query's; far cells give theirs unread."""
    near, far = store.near_cells(query, radius)
    unread = store.table("cell_ids").where(F.col("cell").isin(far)).select("traj_id")
    return unread.union(store.segments(near).where(gap_to(query, radius) > radius).select("traj_id")).distinct()


def in_box(store: Layout, box: tuple[float, float, float, float], test: Column) -> DataFrame:
    """Segments that pass ``test``, which holds for none of which the box doesn't meet ``box``; other cells aren't read."""
    near, _ = store.near_cells(np.array([box]), 0.0)
    return store.segments(near).where(test)


def boxes_within_any(boxes: DataFrame, query: np.ndarray, radius: float) -> DataFrame:
    """Rows of which the box is within ``radius`` of any of ``query`` (n x 4, corners)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = np.stack([x.to_numpy() for x in (a, b, c, d)], axis=1)
        out = np.zeros(len(rows), bool)
        for k in range(0, len(query), 256):
            out |= (box_gaps(rows, query[k : k + 256]) <= radius).any(1)
        return pa.array(out)

    return boxes.where(near(*BOX))


def circle_range(rows: DataFrame, distance: Callable[[tuple], Column], radius: float, shape: tuple = BOX) -> DataFrame:
    """Rows of which ``distance`` (a function of their shape's columns) is ``radius`` at most."""
    return rows.where(distance(shape) <= radius)


def knn(rows: DataFrame, distance: Callable[[tuple], Column], k: int, shape: tuple = BOX, keep_same: bool = False, ties: tuple = ("traj_id",)) -> DataFrame:
    """The k rows of least distance (6 digits), in ``dist``; with ``keep_same`` also all others at the last distance."""
    found = rows.withColumn("dist", F.round(distance(shape), 6))
    if not keep_same:
        return found.orderBy("dist", *ties).limit(k)
    last = found.orderBy("dist").limit(k).agg(F.max("dist").alias("_last"))  # one row
    return found.join(F.broadcast(last), F.col("dist") <= F.col("_last")).drop("_last")


def knn_sized(rows: DataFrame, distance: Callable[[tuple], Column], k: int, size: str, shape: tuple = BOX) -> DataFrame:
    """Rows in order of distance until those before hold ``k`` by their sizes of one at least."""
    near = knn(rows, distance, k, shape)  # no more than k rows can be needed
    before = F.coalesce(F.sum(size).over(Window.orderBy("dist", "traj_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("_before", before).where(F.col("_before") < k).drop("_before")


def selectivity(boxes: DataFrame, query: tuple, size: str, ratio: Callable[[tuple, tuple], Column]) -> float:
    """Share of the rows that a box will find: overlap of each box weighted by its size."""
    return boxes.agg(F.sum(ratio(BOX, query) * F.col(size)) / F.sum(size)).first()[0] or 0.0


def range_or_scan(store: Layout, box: tuple, test: Column, threshold: float, ratio) -> tuple[DataFrame, bool]:
    """(segments that pass, whether cells were chosen): from the cells that meet the box, or of all if
    the estimate by cells is over ``threshold``."""
    if selectivity(store.table("segment_cells"), box, "rows", ratio) > threshold:
        return store.segments().where(test), False
    return in_box(store, box, test), True
