"""Stored trajectories: segments and trajectories in sort-tile cells, with figures of each cell.

A layout is a folder of Parquet tables, written once and read by any session:

- ``segments``: traj_id, seg_id, x1, y1, x2, y2, by the cell of the segment's centre;
- ``trajectories``: those of ``trajectories.assembled``, by the cell of the box's centre;
- ``segment_cells``, ``trajectory_cells``: box, rows and number of trajectories of each cell;
- ``cell_ids``: the trajectories that have a segment in a cell.

Cells come from exact quantiles of the centres (slabs by x, tiles by y in each). Sketches of the tasks bracket
them and a count of the rows between finds them, so no task sorts all rows. Outer cells are open, every
row has a cell.
Searches read the figures first and then only the folders of the cells that they need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise, scratch
from .trajectories import assembled

SEGMENTS_PER_CELL, MOST_CELLS, ACCURACY = 1_000_000, 16_384, 50_000
BOX, SEG = ("xmin", "ymin", "xmax", "ymax"), ("x1", "y1", "x2", "y2")


def _below(cuts: Column, value: Column) -> Column:
    """How many cuts are smaller than the value."""
    return F.size(F.filter(cuts, lambda c: c < value))


def quantiles(rows: DataFrame, value: str, parts: int, by: str) -> dict[int, list[float]]:
    """The values at the ranks ceil(n * k / parts), 0 < k < parts, of each group's n values (not null), exactly.

    Sketches give two values around each rank. Rows are counted by value between these and in one sum
    elsewhere; where the sum shows that a rank lies elsewhere, the brackets become wider."""
    rows, wider, out = rows.where(F.col(value).isNotNull()), 2.0 / ACCURACY, {}
    while True:
        ends = [min(max(k / parts + s * wider, 0.0), 1.0) for s in (-1, 1) for k in range(1, parts)]
        found = rows.where(~F.col(by).isin(list(out))) if out else rows
        sketch = found.groupBy(by).agg(F.percentile_approx(value, ends, ACCURACY).alias("_ends"))
        low, high = F.slice("_ends", 1, parts - 1), F.slice("_ends", parts, parts - 1)
        if wider >= 1:  # all values
            low, high = F.transform(low, lambda _: F.lit(float("-inf"))), F.transform(high, lambda _: F.lit(float("inf")))
        at = found.join(F.broadcast(sketch.select(by, low.alias("_low"), high.alias("_high"))), by)
        place = F.size(F.filter("_low", lambda v: v <= F.col(value))).alias("_place")  # equal for values in the same brackets
        held = F.exists(F.arrays_zip("_low", "_high"), lambda e: (e["_low"] <= F.col(value)) & (F.col(value) <= e["_high"]))
        counts = materialise(at.groupBy(by, place, F.when(held, F.col(value)).alias("_value")).agg(F.count("*").alias("_n")), "quantiles")
        sums = counts.groupBy(by, "_place").agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(by)
        sums = sums.select(by, "_place", (F.sum("_n").over(w.orderBy("_place")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
        each = counts.join(F.broadcast(sums), [by, "_place"])
        upto = F.sum("_n").over(Window.partitionBy(by, "_place").orderBy(F.col("_value").asc_nulls_last())) + F.col("_before")
        each = each.withColumn("_upto", upto)
        ranks = F.array(*[F.ceil(F.col("_all") * k / parts) for k in range(1, parts)])
        hit = each.select(by, "_value", F.posexplode(F.filter(ranks, lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_n")))).alias("_k", "_rank"))
        cuts: dict[int, dict[int, float | None]] = {}
        for r in hit.collect():  # a row for each cut
            cuts.setdefault(r[by], {})[(r["_rank"], r["_k"])] = r["_value"]
        for group, values in cuts.items():
            if None not in values.values():
                out[group] = [values[key] for key in sorted(values)]
        if cuts.keys() <= out.keys():
            return out
        wider *= 16


def tiled(rows: DataFrame, cx: Column, cy: Column, slabs: int, tiles: int) -> DataFrame:
    """``rows`` with cell: slab * tiles + tile, the places of the centre among the quantiles."""
    at = rows.withColumns({"_cx": cx, "_cy": cy})
    centres = materialise(at.select("_cx", "_cy"), "centres")  # what is read several times is narrow
    xs = quantiles(centres.withColumn("_slab", F.lit(0)), "_cx", slabs, "_slab").get(0, []) if slabs > 1 else []
    cuts = F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>")
    at = at.withColumn("_slab", _below(cuts, F.col("_cx")))
    if tiles > 1:
        found = quantiles(centres.withColumn("_slab", _below(cuts, F.col("_cx"))), "_cy", tiles, "_slab")
        ys = rows.sparkSession.createDataFrame(list(found.items()), "_slab int, _ys array<double>")  # a row for each slab
        at = at.join(F.broadcast(ys), "_slab", "left").withColumn("_tile", _below(F.col("_ys"), F.col("_cy")))
    else:
        at = at.withColumn("_tile", F.lit(0))
    return at.withColumn("cell", F.col("_slab") * tiles + F.col("_tile")).drop("_cx", "_cy", "_slab", "_tile", "_ys")


def segment_centre() -> tuple[Column, Column]:
    return (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2


def box_centre() -> tuple[Column, Column]:
    return (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2


def by_partition(rows: DataFrame, partitions: int, key: str) -> DataFrame:
    """Rows with equal non-negative keys in the partition of that number."""
    return rows.repartitionById(partitions, F.col(key).cast("int"))


class Layout:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, segments: DataFrame, path: str | None = None, cells: int | None = None) -> Layout:
        """Write a layout of about ``cells`` cells (default: by the number of segments)."""
        spark = segments.sparkSession
        path = path or scratch(spark, "layout")
        if cells is None:
            cells = min(MOST_CELLS, -(-segments.count() // SEGMENTS_PER_CELL))
        slabs = max(1, math.ceil(math.sqrt(cells)))
        tiles = max(1, math.ceil(cells / slabs))
        rows = tiled(segments.select("traj_id", "seg_id", *SEG), *segment_centre(), slabs, tiles)
        rows.repartition("cell").sortWithinPartitions("cell", "traj_id", "seg_id").write.partitionBy("cell").parquet(f"{path}/segments")
        whole = tiled(assembled(segments), *box_centre(), slabs, tiles)
        whole.repartition("cell").sortWithinPartitions("cell", "traj_id").write.partitionBy("cell").parquet(f"{path}/trajectories")
        out = cls(spark, path)
        low, high = lambda a, b: F.min(F.least(a, b)), lambda a, b: F.max(F.greatest(a, b))
        of = out.segments().groupBy("cell").agg(low("x1", "x2").alias("xmin"), low("y1", "y2").alias("ymin"), high("x1", "x2").alias("xmax"), high("y1", "y2").alias("ymax"), F.count("*").alias("rows"))
        of.coalesce(1).write.parquet(f"{path}/segment_cells")
        of = out.trajectories().groupBy("cell").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("rows"))
        of.coalesce(1).write.parquet(f"{path}/trajectory_cells")
        out.segments().select("cell", "traj_id").distinct().write.parquet(f"{path}/cell_ids")
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def segments(self, cells: list[int] | None = None) -> DataFrame:
        """All segments, or those of some cells; other folders aren't read."""
        return self._some("segments", cells)

    def trajectories(self, cells: list[int] | None = None) -> DataFrame:
        return self._some("trajectories", cells)

    def _some(self, name: str, cells: list[int] | None) -> DataFrame:
        rows = self.table(name)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def cells(self, name: str = "segment_cells") -> list[dict]:
        """The figures of all cells, MOST_CELLS at most or a few more."""
        return [r.asDict() for r in self.table(name).orderBy("cell").collect()]

    def near_cells(self, boxes, radius: float, name: str = "segment_cells") -> tuple[list[int], list[int]]:
        """(cells within ``radius`` of any of ``boxes`` (array, n x 4), all others)."""
        import numpy as np

        from ..functions.kernels import box_gaps

        of = self.cells(name)
        if not of:
            return [], []
        near = np.zeros(len(of), bool)
        table = np.array([[c[n] for n in BOX] for c in of])
        for k in range(0, len(boxes), 256):
            near |= (box_gaps(table, boxes[k : k + 256]) <= radius).any(1)
        return [c["cell"] for c, n in zip(of, near, strict=True) if n], [c["cell"] for c, n in zip(of, near, strict=True) if not n]


_BUILT: dict[tuple, Layout] = {}


def cached(key: tuple, segments: DataFrame, cells: int | None = None) -> Layout:
    """The layout of a key, built once a session."""
    key = (segments.sparkSession.sparkContext.applicationId, *key, cells)
    if key not in _BUILT:
        _BUILT[key] = Layout.build(segments, cells=cells)
    return _BUILT[key]
