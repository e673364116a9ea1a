"""Shared folders, file access and small helpers of the llm operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import scratch, shared_root as checkpoint_root  # noqa: F401


def hadoop(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) on the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back: lineage is cut and nothing runs twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*written: DataFrame) -> None:
    """Remove what ``materialise`` wrote for tables that nothing reads any more."""
    for df in written:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)


def remove_strays(spark: SparkSession, folder: str, names: DataFrame) -> None:
    """Remove the files of a folder that aren't in ``names`` (a row for each file): those of lost attempts."""
    known = {r["name"] for r in names.select("name").collect()}
    fs, p = hadoop(spark, folder)
    if fs.exists(p):
        for status in fs.listStatus(p):
            if status.getPath().getName() not in known:
                fs.delete(status.getPath(), False)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = "_" + name
    return name


def open_fs(path: str):
    """(pyarrow file system, path in it), for use in tasks."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class AtomicFile:
    """A file that appears under its name only when it is complete.

    Names carry an id of the attempt, and only the table of names that Spark's own committer
    publishes says which files count, so a lost executor or a second attempt does no harm.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.final, self.temp = f"{base}/{self.name}", f"{base}/.{self.name}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.written = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.name

    def abort(self) -> None:
        if not self.out.closed:
            self.out.close()
            self.fs.delete_file(self.temp)


def read_file(folder: str, name: str):
    """An input file with random access."""
    fs, base = open_fs(folder)
    return fs.open_input_file(f"{base}/{name}")


def slices(batches, rows: int = 256):
    """Small zero-copy slices, so that what Python holds at once stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def task_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def default_tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
