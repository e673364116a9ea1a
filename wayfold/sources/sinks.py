"""Writers of segments, samples, statistics and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ring_text, rounded
from ..operators.trajectories import relabel


def write_segments(segments: DataFrame, path: str) -> None:
    """Tab-separated traj_id, x1, y1, x2, y2, seg_id."""
    segments.select("traj_id", "x1", "y1", "x2", "y2", "seg_id").write.option("sep", "\t").csv(path)


def write_sample(segments: DataFrame, path: str) -> None:
    """A sample as one file, ids from 0; for what is small enough for one task."""
    dense = segments.join(F.broadcast(relabel(segments.select("traj_id"))), "traj_id")
    out = dense.select(F.col("new_id").alias("traj_id"), "x1", "y1", "x2", "y2", "seg_id")
    out.coalesce(1).sortWithinPartitions("traj_id", "seg_id").write.option("sep", "\t").csv(path)


def stats_lines(stats: DataFrame) -> DataFrame:
    """One line a trajectory: id, number of segments, length and span with six digits."""
    return stats.select("traj_id", F.format_string("%d\t%d\t%.6f\t%.6f", "traj_id", "n_segs", rounded("total_length"), rounded("span")).alias("line"))


def write_stats(stats: DataFrame, path: str) -> None:
    """The lines of ``stats_lines`` in the order of ids over all files."""
    stats_lines(stats).orderBy("traj_id").select("line").write.text(path)


def geometry_collection(boxes: DataFrame, key: str) -> DataFrame:
    """geometry: one GeoJSON GeometryCollection of all boxes as closed rings, in the order of ``key``."""
    corners = [("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin")]
    part = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring_text(corners), F.lit("]}"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("at"), part.alias("part")))), lambda x: x["part"])
    return boxes.agg(F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(parts, ","), F.lit("]}")).alias("geometry"))


def observed(result: DataFrame, name: str):
    """(result, observation): the observation has the number of rows and the largest distance once the
    result was written or collected."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return result.observe(seen, F.count("*").alias("rows"), F.max("dist").alias("farthest")), seen
