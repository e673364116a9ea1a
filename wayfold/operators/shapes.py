"""Polygons over points, line simplification, cell export, generators, n-dimensional search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import ring_text
from ..functions.kernels import simplify
from ..functions.planar import Point, Polygon


def polygon_contains(ring: list[tuple[float, float]], x: str, y: str) -> Column:
    """Whether a point lies inside a closed ring; points on the boundary don't."""
    return Polygon.of(ring).contains(Point(x, y))


def simplified(points: DataFrame, order: str, eps: float) -> DataFrame:
    """traj_id, n_points, n_kept of each polyline after recursive simplification."""

    def run(key, table):
        import pyarrow as pa

        t = table.sort_by(order)
        p = np.stack([t["x"].to_numpy(), t["y"].to_numpy()], axis=1)
        return pa.table({"traj_id": pa.array([key[0].as_py()], pa.int64()), "n_points": pa.array([len(p)], pa.int64()), "n_kept": pa.array([len(simplify(p, eps))], pa.int64())})

    return points.select("traj_id", order, "x", "y").groupBy("traj_id").applyInArrow(run, "traj_id long, n_points long, n_kept long")


def geojson(boxes: DataFrame, key: str) -> DataFrame:
    """key, geometry: a closed five-point ring per box."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    return boxes.select(key, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring_text(corners), F.lit("]}")).alias("geometry"))


def walk(rng, side: float = 100.0, step: float = 5.0, steps: tuple[float, float] = (20.0, 10.0), turn: float = 0.95) -> np.ndarray:
    """Points of a random trajectory: a uniform start, a second point one basic step on (normal, mean of
    the step and half of it as deviation), then points around the middle of the last two, a normal step
    with 0.3 of the basic step as deviation away, in its direction with probability ``turn``. Basic
    steps are normal around 0; the number of points after the second is normal, more than 10."""
    last = rng.uniform(0, side, 2)
    basic = rng.normal(0, step, 2)
    points = [last, last + rng.normal(basic, np.abs(basic) * 0.5)]
    count = 0
    while count <= 10:
        count = int(rng.normal(*steps))
    for _ in range(count):
        sign = np.where(rng.random(2) < turn, 1.0, -1.0)
        points.append((points[-2] + points[-1]) / 2 + sign * rng.normal(basic, np.abs(basic) * 0.3))
    return np.array(points)


def random_walks(spark: SparkSession, n: int, seed: int = 7, **settings) -> DataFrame:
    """traj_id, seq, x, y of ``n`` random trajectories; each depends on the seed and its id only."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                p = walk(np.random.default_rng([seed, i]), **settings)
                yield pa.record_batch({"traj_id": pa.array([i] * len(p), pa.int64()), "seq": pa.array(range(len(p)), pa.int64()), "x": pa.array(p[:, 0]), "y": pa.array(p[:, 1])})

    return spark.range(n).mapInArrow(run, "traj_id long, seq long, x double, y double")


def uniform(seed: int, *keys: str, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in (low, high] that depends on the seed and the keys only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return F.lit(low) + (bits + 1) / F.lit(float(1 << 53)) * (high - low)


def normal(seed: int, *keys: str, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A normal number of the seed and the keys."""
    around = F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * np.pi * uniform(seed + 1_000_003, *keys))
    return F.lit(mean) + around * deviation


def flip(p: float, seed: int, *keys: str) -> Column:
    """1 with probability ``p``, else -1, of the seed and the keys."""
    return F.when(uniform(seed, *keys) <= p, 1).otherwise(-1)


def star_walks(spark: SparkSession, n: int, seed: int = 7, side: float = 100.0, deviation: float = 8.0) -> DataFrame:
    """Segments of ``n`` trajectories of which all steps leave the start point, about 20 of each."""
    count = F.greatest(F.lit(1), normal(seed, "traj_id", mean=20.0, deviation=10.0).cast("int"))
    each = spark.range(n).select(F.col("id").alias("traj_id")).select("traj_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("seg_id"))
    each = each.withColumns({c: uniform(seed + k + 1, "traj_id", high=side) for k, c in enumerate(("x1", "y1"))})
    return each.withColumns({c: F.col(o) + normal(seed + k + 3, "traj_id", "seg_id", deviation=deviation) for k, (c, o) in enumerate((("x2", "x1"), ("y2", "y1")))})


def vector_distance(a: Column, b: Column) -> Column:
    """n-dimensional Euclidean distance over the dimensions that both have."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v.cast("array<double>"), F.lit(1), n)
    return F.sqrt(F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """query_id, vec_id, dist (4 digits) of the k nearest of each query (vec_id, embedding); ties by vec_id.

    Queries go to the tasks in blocks; a task keeps k rows for each query, so its output is bounded."""
    rows, out = [], None
    held = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("vec_id").toLocalIterator()

    def searched(part: list) -> DataFrame:
        ids, table = [r["vec_id"] for r in part], np.array([r["v"] for r in part])

        def run(batches):
            import pyarrow as pa

            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches:
                own = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float) if batch.num_rows else np.zeros((0, table.shape[1]))
                names = batch.column(0).to_pylist()
                for q, query in enumerate(table):
                    dist = np.round(np.sqrt(((own - query) ** 2).sum(1)), 4)
                    some = np.lexsort((names, dist))[:k]
                    best[q] = sorted(best[q] + [(float(dist[j]), names[j]) for j in some])[:k]
            found = [(ids[q], i, d) for q, some in enumerate(best) for d, i in some]
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "dist"])

        return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, dist double")

    for r in held:
        rows.append(r)
        if len(rows) == block:
            out, rows = searched(rows) if out is None else out.unionByName(searched(rows)), []
    if rows:
        out = searched(rows) if out is None else out.unionByName(searched(rows))
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, dist double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return out.withColumn("place", place).where(F.col("place") <= k).drop("place")
