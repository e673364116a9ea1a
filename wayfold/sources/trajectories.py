"""Readers of points, segments, trajectories and shapes, as tables of traj_id, seg_id, x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENTS = "traj_id LONG, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, seg_id INT"


def points_to_segments(points: DataFrame, *order: str) -> DataFrame:
    """traj_id, seg_id, x1, y1, x2, y2 of consecutive points; a single point gives none."""
    w = Window.partitionBy("traj_id").orderBy(*order)
    out = points.select("traj_id", (F.row_number().over(w) - 1).alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.where(F.col("x2").isNotNull())


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.lit("UTC")))
    return e.select(F.col("user_id").alias("traj_id"), "ts", "event_id", ((micros - 1704067200000000) / F.lit(3600000000.0)).alias("x"), F.col("value").cast("double").alias("y"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_to_segments(event_points(spark, sf_dir), "ts", "event_id")


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short trajectories: a customer's orders by day since 1995 and price in thousands."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")).cast("double")
    p = o.select(F.col("o_custkey").alias("traj_id"), "o_orderdate", "o_orderkey", day.alias("x"), (F.col("o_totalprice").cast("double") / 1000).alias("y"))
    return points_to_segments(p, "o_orderdate", "o_orderkey")


def read_segments(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Tab-separated traj_id, x1, y1, x2, y2, seg_id; further columns are ignored."""
    rows = spark.read.schema(SEGMENTS).option("sep", "\t").option("enforceSchema", "true").csv(path)
    return rows.repartition(min_partitions) if min_partitions and rows.rdd.getNumPartitions() < min_partitions else rows


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Query trajectories of a segment file, seg_id by place in the file where it has none; the first
    ``limit`` ids in ascending order."""
    rows = spark.read.schema(SEGMENTS).option("sep", "\t").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.select("*", F.row_number().over(Window.partitionBy("traj_id").orderBy(place)).alias("place"))
    rows = rows.select("traj_id", F.coalesce("seg_id", F.col("place") - 1).alias("seg_id"), "x1", "y1", "x2", "y2")
    if limit is None:
        return rows
    first = rows.select("traj_id").distinct().orderBy("traj_id").limit(limit)
    return rows.join(first, "traj_id", "left_semi")


def read_single_query(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a file as one trajectory 0 in their order; ids are ignored."""
    rows = spark.read.schema(SEGMENTS).option("sep", "\t").csv(path).drop("traj_id", "seg_id")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.select("*", F.lit(0).cast("long").alias("traj_id"), place.alias("place"))
    w = Window.partitionBy("traj_id").orderBy("place")  # one query
    return rows.select("traj_id", (F.row_number().over(w) - 1).alias("seg_id"), "x1", "y1", "x2", "y2")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """traj_id (string), place, x (longitude), y (latitude) of tab-separated id, latitude, longitude lines."""
    rows = spark.read.schema("traj_id STRING, lat DOUBLE, lon DOUBLE").option("sep", "\t").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("traj_id", place.alias("place"), F.col("lon").alias("x"), F.col("lat").alias("y"))


def parse_point_list(line) -> list:
    """(traj_id, points (array of x, y)) of a line "id x0 y0 x1 y1 ..."."""
    parts = F.filter(F.split(line, " "), lambda p: p != "")
    n = F.size(parts)
    at = F.when(n >= 3, F.sequence(F.lit(2), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    points = F.transform(at, lambda k: F.struct(F.element_at(parts, k).cast("double").alias("x"), F.element_at(parts, k + 1).cast("double").alias("y")))
    return [F.element_at(parts, 1).cast("long").alias("traj_id"), points.alias("points")]


def read_point_lists(spark: SparkSession, path: str) -> DataFrame:
    """Segments of point-list lines."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(*parse_point_list(F.trim("value")))
    each = rows.select("traj_id", F.posexplode("points").alias("place", "p")).select("traj_id", "place", "p.x", "p.y")
    return points_to_segments(each, "place")


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, place, lat, lon of GPX tracks: traj_id is nine characters of the file's name before
    ".gpx", a dash and the track's number in its file; points go by segment and place."""
    point = "STRUCT<_lat: DOUBLE, _lon: DOUBLE>"
    tracks = spark.read.format("xml").option("rowTag", "trk").schema(f"trkseg ARRAY<STRUCT<trkpt: ARRAY<{point}>>>").load(path)
    name = F.regexp_extract("file", r"([^/]{0,9})\.gpx$", 1)
    tracks = tracks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "trkseg")
    numbered = tracks.withColumn("track", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1)
    points = numbered.select(F.concat_ws("-", name, F.col("track")).alias("traj_id"), F.posexplode("trkseg").alias("seg", "part")).select("traj_id", "seg", F.posexplode("part.trkpt").alias("k", "p"))
    return points.select("traj_id", F.struct("seg", "k").alias("place"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"))
