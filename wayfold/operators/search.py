"""Distances to query trajectories and exact top-k by scan, for one query or many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import DISTANCES, box_gaps, grid, maybe_within, measured, point_gaps
from .metric import arrays
from .trajectories import assembled

#: Segments of all queries that tasks get at once; more queries go in further blocks.
BLOCK_SEGMENTS = 100_000
#: Trajectories that a task measures against a query before it looks at the bound again.
STEP = 32
#: Trajectories that a task looks at together, and how many of them it measures for a bound of each query.
ROWS, PROBES = 2_048, 2
#: Points of a coarse and a fine grid, to which the distances of trajectories are compared.
COARSE, FINE = (16, 4), (24, 6)


def query_arrays(queries: DataFrame) -> Iterator[dict[int, np.ndarray]]:
    """Segments by traj_id, n x 4, in blocks of about BLOCK_SEGMENTS; a longer query is a block of its own."""
    block, held = {}, 0
    for r in assembled(queries).select("traj_id", "segs").orderBy("traj_id").toLocalIterator():
        one = np.array(r["segs"]).reshape(-1, 4)
        if block and held + len(one) > BLOCK_SEGMENTS:
            yield block
            block, held = {}, 0
        block[r["traj_id"]] = one
        held += len(one)
    if block:
        yield block


def query_array(query: DataFrame) -> np.ndarray:
    """A query's segments in the order of seg_id; its ids aren't looked at."""
    one = query.withColumn("traj_id", F.lit(0).cast("long"))
    for block in query_arrays(one):
        return block[0]
    raise ValueError("a query has one segment at least")


def trajectory_distances(trajectories: DataFrame, query: np.ndarray, distance="hausdorff", partitions: int | None = None) -> DataFrame:
    """traj_id, dist of every row of ``assembled``; ``distance`` is a name or a function of two arrays.
    With ``partitions`` rows are dealt out anew first, for few rows with long trajectories."""
    measure = DISTANCES.get(distance, distance) if isinstance(distance, str) else distance

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch({"traj_id": batch.column("traj_id"), "dist": pa.array(measured(arrays(batch), query, measure), pa.float64())})

    rows = trajectories.select("traj_id", "segs")
    return (rows.repartition(partitions) if partitions else rows).mapInArrow(run, "traj_id long, dist double")


def distances(segments: DataFrame, query: np.ndarray, distance="hausdorff") -> DataFrame:
    """traj_id, dist of every trajectory of a segment table."""
    return trajectory_distances(assembled(segments), query, distance)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k least distances (6 digits), ties by traj_id."""
    return found.select("traj_id", F.round("dist", 6).alias("dist")).orderBy("dist", "traj_id").limit(k)


def topk(segments: DataFrame, query: DataFrame, k: int = 10, distance="hausdorff") -> DataFrame:
    """traj_id, dist of the k nearest by the distance to every trajectory."""
    return best(distances(segments, query_array(query), distance), k)


class _Part:
    """Trajectories with lower bounds of their distances to a query: the largest difference of the distances
    to the points of a grid for Hausdorff and Frechet distance, the gap of the boxes for other measures."""

    def __init__(self, segs: list[np.ndarray], ids: list[int], points: np.ndarray, distance: str):
        self.segs, self.ids, self.measure = segs, ids, DISTANCES[distance]
        self.by_points = distance in ("hausdorff", "frechet")
        self.table = point_gaps(segs, points) if self.by_points else _boxes(segs)

    def nearest(self, query: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """The n trajectories with the least lower bounds."""
        low = self._lower(own)
        return np.argpartition(low, n - 1)[:n] if n < len(low) else np.arange(len(low))

    def _lower(self, own: np.ndarray) -> np.ndarray:
        if not self.by_points:
            return box_gaps(self.table, own[None])[:, 0]
        n = COARSE[0] * COARSE[1]
        return np.abs(self.table[:n] - own[:n, None]).max(0)

    def search(self, query: np.ndarray, own: np.ndarray, rows: list, k: int, bound: float) -> None:
        """Put what is among the k nearest into ``rows`` (distance, id), sorted; what the bound or the k-th
        row excludes isn't measured."""
        slack = 1e-6 + 1e-12 * np.abs(query).max()  # distances have 6 digits
        now = lambda: (min(bound, rows[k - 1][0]) if len(rows) >= k else bound) + slack
        low = self._lower(own)
        left = np.flatnonzero(low <= now())
        if self.by_points and len(left):
            n = COARSE[0] * COARSE[1]
            low[left] = np.maximum(low[left], np.abs(self.table[n:, left] - own[n:, None]).max(0))
        left = left[np.argsort(low[left], kind="stable")]
        for begin in range(0, len(left), STEP):
            limit, some = now(), left[begin : begin + STEP]
            some = some[low[some] <= limit]
            if len(some) and self.by_points and np.isfinite(limit):
                some = some[maybe_within([self.segs[j] for j in some], query, limit)]
            self.put(query, some, rows, k)

    def put(self, query: np.ndarray, some: np.ndarray, rows: list, k: int) -> None:
        if len(some):
            dist = np.round(measured([self.segs[j] for j in some], query, self.measure), 6)
            rows += [(d, self.ids[j]) for d, j in zip(dist.tolist(), some.tolist(), strict=True)]
            rows.sort()
            del rows[k:]


def _boxes(segs: list[np.ndarray]) -> np.ndarray:
    return np.array([[*np.minimum(s[:, :2], s[:, 2:]).min(0), *np.maximum(s[:, :2], s[:, 2:]).max(0)] for s in segs]).reshape(-1, 4)


def _points(trajectories: DataFrame) -> np.ndarray:
    """Coarse and fine grid over the boxes of the trajectories, but for few that are far out."""
    ends = [F.percentile_approx(c, q, 1_000) for c, q in (("xmin", 0.02), ("ymin", 0.02), ("xmax", 0.98), ("ymax", 0.98))]
    box = [v or 0.0 for v in trajectories.agg(*ends).first()]
    return np.concatenate([grid(box[:2], box[2:], *size) for size in (COARSE, FINE)])


def topk_many(trajectories: DataFrame, queries: DataFrame, k: int = 10, distance: str = "hausdorff") -> DataFrame:
    """query_id, traj_id, dist: the k nearest of every query (segments with traj_id as their id).

    Lower bounds come from distances to the points of a grid (``_Part``). A first scan measures, in each task,
    the few trajectories with the least lower bounds; the k-th of all these bounds a query's distances.
    The second measures what the bound leaves, and a task keeps k rows for each query. Both are done once
    for each block of queries."""
    out, points, spark = None, _points(trajectories), trajectories.sparkSession
    dealt = trajectories.select("traj_id", "segs").repartition(4 * spark.sparkContext.defaultParallelism, "traj_id")
    schema = "query_id long, traj_id long, dist double"
    for block in query_arrays(queries):
        owns = _Part(list(block.values()), [], points, distance).table
        each = list(zip(block, block.values(), owns.T if distance in ("hausdorff", "frechet") else owns, strict=True))

        def run(batches, bounds, each=each):
            import pyarrow as pa

            held: dict[int, list[tuple[float, int]]] = {q: [] for q, _, _ in each}
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(begin, ROWS)
                    part = _Part(arrays(rows), rows.column("traj_id").to_pylist(), points, distance)
                    for q, query, own in each:
                        if bounds is None:
                            part.put(query, part.nearest(query, own, PROBES), held[q], k)
                        else:
                            part.search(query, own, held[q], k, bounds.get(q, np.inf))
            rows = [(q, i, d) for q, some in held.items() for d, i in some]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "traj_id", "dist"])

        place = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "traj_id"))
        probed = dealt.mapInArrow(lambda batches, run=run: run(batches, None), schema)
        bounds = {r["query_id"]: r["dist"] for r in probed.withColumn("place", place).where(F.col("place") == k).collect()}  # a row for each query of the block
        found = dealt.mapInArrow(lambda batches, run=run, bounds=bounds: run(batches, bounds), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return trajectories.sparkSession.createDataFrame([], "query_id long, traj_id long, dist double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "traj_id"))
    return out.withColumn("place", place).where(F.col("place") <= k).drop("place")
