"""Top-k similar trajectories over a stored layout: interchangeable plans with one answer.

Every plan but the scan starts from a bound, the k-th least distance of a few trajectories whose boxes
are near the query's. Hausdorff and Frechet distances alike are no less than the distance of any
segment of one trajectory to the other as a whole, hence

- a trajectory with a segment farther than the bound from all of the query's can't be an answer; it
  is ``prunable``. Cells that are wholly farther give their ids without being read;
- a trajectory of which the box is farther than the bound from the query's boxes can't be one either.

The plans differ in what they store and hold: ids to leave out or to keep, as rows, bitmaps or Bloom
filters, and trajectories from their own table (``dual``) or put together from segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.kernels import box_gaps
from ..operators import idsets
from ..operators.layout import BOX, SEG, Layout
from ..operators.metric import MetricCells
from ..operators.search import best, trajectory_distances
from ..operators.trajectories import assembled

STRATEGIES = ("scan", "dual", "keep", "bitmap", "bloom", "bloom_dual", "mbr")
#: Results have 6 digits, so what rounds to the bound counts.
SLACK = 1e-6


def whole_box(query: np.ndarray) -> tuple[float, ...]:
    return (*np.minimum(query[:, :2], query[:, 2:]).min(0).tolist(), *np.maximum(query[:, :2], query[:, 2:]).max(0).tolist())


def far_from_all(query: np.ndarray, limit: float, box: tuple[str, ...] = SEG):
    """Whether the box of a row's segment (or a box) is farther than ``limit`` from those of all of the query's segments."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def far(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = np.stack([x.to_numpy() for x in (a, b, c, d)], axis=1)
        out = np.ones(len(rows), bool)
        for k in range(0, len(query), 256):
            at = np.flatnonzero(out)  # those that were near already are known
            for j in range(0, len(at), 4_096):
                part = at[j : j + 4_096]
                out[part] &= ~(box_gaps(rows[part], query[k : k + 256]) <= limit).any(1)
        return pa.array(out)

    return far(*box)


def bound(store: Layout, query: np.ndarray, k: int, c: int, distance) -> float:
    """The k-th least distance of the c * k trajectories with the nearest boxes; infinity if there are fewer than k."""
    own = whole_box(query)
    gap = G.mbr_mbr(BOX, own)
    apart = G.point_point((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, (own[0] + own[2]) / 2, (own[1] + own[3]) / 2)
    size = F.abs(F.col("xmax") - F.col("xmin") - (own[2] - own[0])) + F.abs(F.col("ymax") - F.col("ymin") - (own[3] - own[1]))
    near = store.trajectories().select("traj_id", "cell", gap.alias("gap"), (apart + size).alias("apart")).orderBy("gap", "apart", "traj_id").limit(c * k).collect()
    some = store.trajectories(sorted({r["cell"] for r in near})).where(F.col("traj_id").isin([r["traj_id"] for r in near]))
    found = trajectory_distances(some, query, distance).orderBy("dist").limit(k).collect()
    return float(found[-1]["dist"]) * (1 + 1e-9) + SLACK if len(found) == k else float("inf")


def prunable(store: Layout, query: np.ndarray, limit: float) -> DataFrame:
    """traj_id (repeated) of trajectories with a segment farther than ``limit`` from all of the query's."""
    near, far = store.near_cells(query, limit)
    ids = store.table("cell_ids").where(F.col("cell").isin(far)).select("traj_id")
    return ids.union(store.segments(near).where(far_from_all(query, limit)).select("traj_id"))


def within_any(store: Layout, query: np.ndarray, limit: float) -> DataFrame:
    """traj_id (repeated) of trajectories with a segment within ``limit`` of one of the query's, by boxes."""
    near, _ = store.near_cells(query, limit)
    return store.segments(near).where(~far_from_all(query, limit)).select("traj_id")


def candidates(store: Layout, query: np.ndarray, limit: float, strategy: str) -> DataFrame:
    """The trajectories, as of ``assembled``, that can be within ``limit``, from the cells that can hold them."""
    at = np.array([whole_box(query)])
    whole = store.trajectories(store.near_cells(at, limit, "trajectory_cells")[0]).where(G.mbr_mbr(BOX, tuple(at[0].tolist())) <= limit)
    near = store.segments(store.near_cells(query, limit)[0])  # an answer has no segment elsewhere
    if strategy == "mbr":
        return whole.where(~far_from_all(query, limit, BOX))
    if strategy == "dual":
        return whole.join(prunable(store, query, limit).distinct(), "traj_id", "left_anti")
    if strategy == "keep":
        return assembled(near.join(prunable(store, query, limit).distinct(), "traj_id", "left_anti"))
    if strategy == "bitmap":
        kept = idsets.complement(idsets.of(prunable(store, query, limit)), idsets.of(store.table("cell_ids")))
        return assembled(idsets.has(near, kept))
    kept = within_any(store, query, limit).distinct()
    bits = idsets.bloom_bits(max(1, sum(c["rows"] for c in store.cells("trajectory_cells"))), 0.1)
    seeds = idsets.bloom_seeds(idsets.bloom_hashes(max(1, sum(c["rows"] for c in store.cells("trajectory_cells"))), bits))
    bloom = idsets.bloom_filter(kept, "traj_id", bits, seeds)
    if strategy == "bloom":
        return assembled(idsets.may_contain(store.segments(), bloom, "traj_id", bits, seeds))
    if strategy == "bloom_dual":
        return idsets.may_contain(whole, bloom, "traj_id", bits, seeds)
    raise ValueError(strategy)


def topk(store: Layout, query: np.ndarray, k: int = 10, c: int = 5, distance="hausdorff", strategy: str = "dual") -> DataFrame:
    """traj_id, dist (6 digits) of the k nearest; ties by traj_id."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    limit = float("inf") if strategy == "scan" else bound(store, query, k, c, distance)
    rows = store.trajectories() if limit == float("inf") else candidates(store, query, limit, strategy)
    return best(trajectory_distances(rows, query, distance), k)


def topk_cells(cells: MetricCells, query: np.ndarray, k: int = 10) -> DataFrame:
    """The same by pivot cells and vantage trees."""
    return cells.nearest(query, k)


def counted(store: Layout, query: np.ndarray, k: int = 10, c: int = 5, distance="hausdorff", strategy: str = "dual") -> dict:
    """What a plan does: bound, cells read and all, candidates and all trajectories."""
    limit = bound(store, query, k, c, distance)
    near, far = store.near_cells(query, limit)
    return {"bound": limit, "cells_read": len(near), "cells": len(near) + len(far), "candidates": candidates(store, query, limit, strategy).count(), "trajectories": store.trajectories().count()}
