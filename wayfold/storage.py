"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests, a
    temporary folder takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root; it goes when the driver's process ends."""
    path = f"{shared_root(spark)}/wayfold/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch only
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back: lineage is cut and nothing runs twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
