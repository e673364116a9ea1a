"""Segments from a stream of points, and their append to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = "traj_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"
_STATE = "last_x double, last_y double, next_seg long"


def segments_of_stream(points: DataFrame) -> DataFrame:
    """Segments of a stream of traj_id, at (timestamp), x, y. The state of a trajectory is its last point
    and next seg_id; points of one trajectory within a batch go by time, later batches follow."""
    import pandas as pd

    def step(key, batches, state):
        last = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        x, y, number = list(rows["x"]), list(rows["y"]), last[2]
        if state.exists:
            x, y = [last[0], *x], [last[1], *y]
        state.update((float(x[-1]), float(y[-1]), number + len(x) - 1))
        yield pd.DataFrame({"traj_id": key[0], "seg_id": range(number, number + len(x) - 1), "x1": x[:-1], "y1": y[:-1], "x2": x[1:], "y2": y[1:]})

    grouped = points.select(F.col("traj_id").cast("long").alias("traj_id"), "at", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("traj_id")
    return grouped.applyInPandasWithState(step, SEGMENT, _STATE, "append", "NoTimeout")


def append_stream(segments: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends segments to a Parquet table, each batch once."""
    return segments.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(points: DataFrame, width: str, late: str) -> DataFrame:
    """Points and trajectories of each window of time; points later than ``late`` are left out."""
    return points.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count("*").alias("points"), F.approx_count_distinct("traj_id").alias("trajectories"))
