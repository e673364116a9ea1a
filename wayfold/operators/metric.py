"""Metric search over trajectories: pivot cells with cover radii, and a vantage-point tree in kernels."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import DISTANCES, measured
from ..storage import materialise
from .layout import by_partition

Distance = Callable[[np.ndarray, np.ndarray], float]
LEAF = 25


class VantageTree:
    """Items split at the median distance to a vantage point; leaves hold fewer than ``leaf`` items."""

    def __init__(self, items: list, distance: Distance, leaf: int = LEAF, seed: int = 7):
        self.distance, self.checked = distance, 0
        rng = np.random.default_rng(seed)

        def split(part: list):
            if len(part) < leaf:
                return part
            k = int(rng.integers(len(part)))
            point, rest = part[k], part[:k] + part[k + 1 :]
            apart = np.array([distance(point[1], x[1]) for x in rest])
            cut = float(np.median(apart))
            inner, outer = [x for x, d in zip(rest, apart, strict=True) if d <= cut], [x for x, d in zip(rest, apart, strict=True) if d > cut]
            return rest and (point, cut, split(inner), split(outer)) if outer else part  # equal distances don't split

        self.root = split(list(items))

    def nearest(self, query: np.ndarray, k: int, within: float = float("inf")) -> list[tuple[float, object]]:
        """(distance, id) of the k nearest not farther than ``within``, ascending, ties by id; ``checked`` counts distances."""
        held: list[tuple[float, object]] = []  # negative distance, negative id: the worst comes first

        def offer(item) -> float:
            self.checked += 1
            d = self.distance(item[1], query)
            if d <= within:
                heapq.heappush(held, (-d, -item[0]))
                if len(held) > k:
                    heapq.heappop(held)
            return d

        def visit(node) -> None:
            if isinstance(node, list):
                for item in node:
                    offer(item)
                return
            point, cut, inner, outer = node
            d = offer(point)
            for part, gap in sorted(((inner, d - cut), (outer, cut - d)), key=lambda x: x[1]):
                if gap <= (min(within, -held[0][0]) if len(held) == k else within):
                    visit(part)

        visit(self.root)
        return sorted((-d, -i) for d, i in held)

    def ranked(self, query: np.ndarray, within: float = float("inf")) -> Iterator[tuple[float, object]]:
        """All items not farther than ``within`` in ascending order, found as far as they are asked for."""
        heap: list[tuple[float, int, int, object]] = [(0.0, 0, 0, self.root)]
        made = 1
        while heap:
            low, kind, _, node = heapq.heappop(heap)
            if low > within:
                return
            if kind:
                yield low, node
                continue
            items, parts = (node, []) if isinstance(node, list) else ([node[0]], [node[2], node[3]])
            for item in items:
                self.checked += 1
                d = self.distance(item[1], query)
                heapq.heappush(heap, (d, 1, item[0], item[0]))
                if parts:
                    for part, gap in zip(parts, (d - node[1], node[1] - d), strict=True):
                        made += 1
                        heapq.heappush(heap, (max(low, gap, 0.0), 0, made, part))


def arrays(batch, column: str = "segs") -> list[np.ndarray]:
    """The segments of each row of an Arrow batch, n x 4, without a copy."""
    lists = batch.column(column)
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b].reshape(-1, 4) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pivot_cells(trajectories: DataFrame, pivots: list[tuple[int, np.ndarray]], distance: str = "hausdorff") -> DataFrame:
    """traj_id, n_segs, segs, pivot (the place of the nearest in ``pivots``, the first of equals), pivot_dist."""
    measure = DISTANCES[distance]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            rows = arrays(batch)
            table = np.stack([measured(rows, p, measure) for _, p in pivots], axis=1)
            best = table.argmin(1)
            yield pa.record_batch({n: batch.column(n) for n in ("traj_id", "n_segs", "segs")} | {"pivot": pa.array(best, pa.int64()), "pivot_dist": pa.array(table[np.arange(len(best)), best])})

    return trajectories.select("traj_id", "n_segs", "segs").mapInArrow(assign, "traj_id long, n_segs long, segs array<double>, pivot long, pivot_dist double")


class MetricCells:
    """Trajectories by their nearest pivot, each cell with its cover radius and size; a table that is
    written once. ``insert`` and ``remove`` give new tables."""

    def __init__(self, members: DataFrame, pivots: list[tuple[int, np.ndarray]], distance: str):
        self.members, self.pivots, self.distance = members, pivots, distance
        rows = members.groupBy("pivot").agg(F.max("pivot_dist").alias("radius"), F.count("*").alias("size")).collect()  # a row a pivot
        self.cells = {r["pivot"]: (r["radius"], r["size"]) for r in rows}

    @classmethod
    def build(cls, trajectories: DataFrame, count: int, distance: str = "hausdorff") -> MetricCells:
        """``count`` pivots, bounded, by the MD5 of the id."""
        chosen = trajectories.select("traj_id", "segs").orderBy(F.md5(F.col("traj_id").cast("string"))).limit(count).collect()
        pivots = [(r["traj_id"], np.array(r["segs"]).reshape(-1, 4)) for r in chosen]
        found = by_partition(pivot_cells(trajectories, pivots, distance), max(1, len(pivots)), "pivot")
        return cls(materialise(found, "metric-cells"), pivots, distance)

    def insert(self, trajectories: DataFrame) -> MetricCells:
        more = pivot_cells(trajectories, self.pivots, self.distance)
        return MetricCells(materialise(self.members.unionByName(more), "metric-cells"), self.pivots, self.distance)

    def remove(self, ids: DataFrame) -> MetricCells:
        return MetricCells(materialise(self.members.join(ids.select("traj_id"), "traj_id", "left_anti"), "metric-cells"), self.pivots, self.distance)

    def _to_query(self, query: np.ndarray) -> list[tuple[float, int]]:
        measure = DISTANCES[self.distance]
        return sorted((measure(p, query), k) for k, (_, p) in enumerate(self.pivots) if k in self.cells)

    def _near(self, order: list[tuple[float, int]], query: np.ndarray, limit: float) -> DataFrame:
        """traj_id, dist of the rows that the triangle inequality leaves: first whole cells, then rows by
        their distance to the pivot."""
        from .search import trajectory_distances

        apart = {cell: d for d, cell in order}
        reach = limit * (1 + 1e-9) + 1e-9
        cells = [cell for d, cell in order if d - self.cells[cell][0] <= reach]
        to_query = F.element_at(F.array(*[F.lit(float(apart.get(k, 0.0))) for k in range(len(self.pivots))]), F.col("pivot").cast("int") + 1)
        rows = self.members.where(F.col("pivot").isin(cells)).where(F.abs(F.col("pivot_dist") - to_query) <= reach)
        return trajectory_distances(rows, query, self.distance).where(F.col("dist") <= reach)

    def within(self, query: np.ndarray, radius: float) -> DataFrame:
        """traj_id, dist of all not farther than ``radius``, ascending."""
        found = self._near(self._to_query(query), query, radius).where(F.col("dist") <= radius)
        return found.select("traj_id", F.round("dist", 6).alias("dist")).orderBy("dist", "traj_id")

    def nearest(self, query: np.ndarray, k: int, within: float = float("inf")) -> DataFrame:
        """traj_id, dist of the k nearest not farther than ``within``: first the nearest pivots' cells until
        they hold k, for a bound, then all that it leaves."""
        from .search import best, trajectory_distances

        order, held, first = self._to_query(query), 0, []
        for _, cell in order:
            if held >= k:
                break
            first.append(cell)
            held += self.cells[cell][1]
        limit = within
        if held >= k:
            found = trajectory_distances(self.members.where(F.col("pivot").isin(first)), query, self.distance).orderBy("dist").limit(k).collect()
            limit = min(within, found[-1]["dist"] + 1e-6)  # results have 6 digits
        return best(self._near(order, query, limit), k)


def tree_topk(trajectories: DataFrame, query: np.ndarray, k: int, distance: str = "hausdorff") -> DataFrame:
    """traj_id, dist of the k nearest by a vantage-point tree of each batch; the trees see only batches, so memory is bounded."""
    from .search import best

    measure = DISTANCES[distance]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            tree = VantageTree(list(zip(batch.column("traj_id").to_pylist(), arrays(batch), strict=True)), measure)
            rows = tree.nearest(query, k)
            if len(rows) == k:  # with all that may round to the same
                rows = [(d, i) for d, i in tree.ranked(query, rows[-1][0] + 1e-6)]
            yield pa.record_batch({"traj_id": pa.array([i for _, i in rows], pa.int64()), "dist": pa.array([d for d, _ in rows], pa.float64())})

    return best(trajectories.select("traj_id", "segs").mapInArrow(run, "traj_id long, dist double"), k)
