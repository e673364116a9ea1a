"""Per-trajectory aggregates, filters, samples and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point_point
from ..storage import materialise

_BOXED = [("xmin", F.min, F.least, "x1", "x2"), ("ymin", F.min, F.least, "y1", "y2"), ("xmax", F.max, F.greatest, "x1", "x2"), ("ymax", F.max, F.greatest, "y1", "y2")]


def _box() -> list:
    return [total(each(a, b)).alias(name) for name, total, each, a, b in _BOXED]


def boxes(segments: DataFrame, *by: str) -> DataFrame:
    return segments.groupBy(*(by or ("traj_id",))).agg(*_box(), F.count("*").alias("n_segs"))


def stats(segments: DataFrame) -> DataFrame:
    """traj_id, n_segs, total_length, span (diagonal of the box), in one aggregate."""
    each = segments.groupBy("traj_id").agg(*_box(), F.count("*").alias("n_segs"), F.sum(point_point("x1", "y1", "x2", "y2")).alias("total_length"))
    return each.select("traj_id", "n_segs", point_point("xmin", "ymin", "xmax", "ymax").alias("span"), "total_length")


def summary(table: DataFrame, columns: list[str]) -> DataFrame:
    """measure, avg, min, max, std, var, median, p5, p95 of each column (population figures), in one pass."""
    figures = [("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop), ("var", F.var_pop), ("median", F.median)]
    values = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns]
    each = table.select(F.explode(F.array(*values)).alias("m")).select("m.*")
    return each.groupBy("measure").agg(*[F.round(f("v"), 4).alias(n) for n, f in figures], *[F.round(F.percentile("v", F.lit(q)), 4).alias(n) for n, q in (("p5", 0.05), ("p95", 0.95))])


def span_filter(segments: DataFrame, low: float, high: float, more_than: int) -> DataFrame:
    """Segments of trajectories with low < span < high and more than so many segments."""
    good = stats(segments).where((F.col("span") > low) & (F.col("span") < high) & (F.col("n_segs") > more_than))
    return segments.join(good, "traj_id", "left_semi")


def relabel(ids: DataFrame, partitions: int | None = None) -> DataFrame:
    """traj_id, new_id: dense numbers from 0 in the order of ids of any type.

    Ids are ranged over partitions and written; a partition's numbers begin after the sizes of those
    before it, so no task sorts all ids."""
    n = partitions or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(ids.select("traj_id").distinct().repartitionByRange(n, "traj_id").withColumn("part", F.spark_partition_id()), "ranged-ids")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("traj_id")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").select("traj_id", (F.col("before") + F.col("place")).cast("long").alias("new_id"))


def sample(segments: DataFrame, count: int) -> DataFrame:
    """Segments of exactly ``count`` trajectories (or all), chosen by the MD5 of the id."""
    ids = segments.select("traj_id").distinct().orderBy(F.md5(F.col("traj_id").cast("string"))).limit(count)
    return segments.join(ids, "traj_id", "left_semi")


def sample_rate(segments: DataFrame, rate: float) -> DataFrame:
    """Segments of the trajectories whose MD5 lies below the rate, seg_id numbered anew from 0."""
    below = F.substring(F.md5(F.col("traj_id").cast("string")), 1, 8) < F.lit(f"{min(int(rate * 2**32), 2**32 - 1):08x}")
    place = F.row_number().over(Window.partitionBy("traj_id").orderBy("seg_id")) - 1
    return segments.where(below).withColumn("seg_id", place)


def sample_rows(rows: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """Rows at a rate, without replacement."""
    return rows.sample(False, rate, seed)


def assembled(segments: DataFrame) -> DataFrame:
    """traj_id, n_segs, box, segs (x1, y1, x2, y2 of all segments in the order of seg_id, flat)."""
    rows = F.sort_array(F.collect_list(F.struct("seg_id", "x1", "y1", "x2", "y2")))
    flat = F.flatten(F.transform("rows", lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"])))
    grouped = segments.groupBy("traj_id").agg(*_box(), F.count("*").alias("n_segs"), rows.alias("rows"))
    return grouped.select("traj_id", "n_segs", "xmin", "ymin", "xmax", "ymax", flat.alias("segs"))


def exploded(trajectories: DataFrame) -> DataFrame:
    """The segments of ``assembled`` again."""
    each = trajectories.select("traj_id", "segs", F.explode(F.sequence(F.lit(0), F.col("n_segs").cast("int") - 1)).alias("seg_id"))
    return each.select("traj_id", "seg_id", *[F.element_at("segs", 4 * F.col("seg_id") + k + 1).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def runs(rows: DataFrame, order: str, key: str = "traj_id") -> DataFrame:
    """``rows`` with run: a number for each stretch of equal keys in the order given, within partitions
    of one file; what a reader sees that starts a trajectory wherever the id changes."""
    w = Window.partitionBy("file").orderBy(order)
    changed = F.coalesce((F.lag(key).over(w) != F.col(key)).cast("int"), F.lit(1))
    return rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w)).drop("changed")
