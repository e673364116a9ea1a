"""Operator 6: sharded storage with size-tiered compaction (DataFrame operations only).

Arrivals are appended as small immutable Parquet shards. A version names the shards that count; each
change writes the next one beside the old and renames it into place, which fails if that version
exists, so readers see one version or the other. A version holds what it adds and removes, and every
SNAPSHOT-th all shards, so an append doesn't write the list of a large store again. A writer that
finds its version taken tries again on the newest one; a compaction does so if its shards are still
there, else it starts anew, and what it wrote goes.

Compaction takes tiers of similarly sized shards, from the smallest up: a tier with ``fanout`` shards
or more is read, its partitions are coalesced, without a shuffle, to files of about ``target`` bytes,
and the new shards replace the old in one commit. Jobs are one per tier. The old shards stay, so that
readers of older versions don't fail, until ``expire`` drops those versions.

Defined results: rows are kept as they are, nulls, long texts and repeated rows included; an empty
table gives a version without shards; all columns of the input are stored, whatever their names; a
column that an append lacks is null in its rows; one whose type changes is an error. The file system
must rename atomically.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import hadoop, remove

TARGET_BYTES, FANOUT, ARRIVALS, SNAPSHOT, TRIES = 64_000_000, 4, 4, 16, 50


class VersionTaken(Exception):
    """Another writer has published that version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self.fs, root = hadoop(spark, self.path)
        self.fs.mkdirs(root)

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._p(""))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-"))

    def _load(self, version: int) -> dict:
        stream = self.fs.open(self._p(f"manifest-{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, shards of the newest version, or of an older one."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        steps = [self._load(version)]
        while "shards" not in steps[-1]:
            steps.append(self._load(steps[-1]["version"] - 1))
        shards = {s["name"]: s for s in steps.pop()["shards"]}
        for step in reversed(steps):
            shards = {n: s for n, s in shards.items() if n not in set(step["removed"])} | {s["name"]: s for s in step["added"]}
        return {"version": version, "schema": self._load(version)["schema"], "shards": sorted(shards.values(), key=lambda s: s["name"])}

    def _commit(self, old: dict, schema: str | None, added: list[dict], removed: list[str]) -> dict:
        """Publish the version after ``old``; VersionTaken if another writer was first."""
        shards = sorted([s for s in old["shards"] if s["name"] not in set(removed)] + added, key=lambda s: s["name"])
        new = {"version": old["version"] + 1, "schema": schema, "shards": shards}
        full = new["version"] % SNAPSHOT == 1 or new["version"] - 1 not in self.versions()
        data = new if full else {"version": new["version"], "schema": schema, "added": added, "removed": removed}
        try:
            self._publish(data, "NONE")
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise VersionTaken(new["version"]) from error
            raise
        return new

    def _publish(self, data: dict, mode: str) -> None:
        """Write a version and rename it into place: mode NONE fails if it exists, OVERWRITE replaces it."""
        sc, temp, final = self.spark.sparkContext, self._p(f".new-{uuid.uuid4().hex}"), self._p(f"manifest-{data['version']:012d}.json")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = getattr(kind, mode)
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self.fs.getUri(), sc._jsc.hadoopConfiguration()).rename(temp, final, options)
        except Py4JJavaError:
            self.fs.delete(temp, False)
            raise

    def _merged(self, schema: str | None, kind: StructType) -> str:
        """The schema of the store with the columns of ``kind``."""
        fields = {f.name: f for f in StructType.fromJson(json.loads(schema)).fields} if schema else {}
        for f in kind.fields:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, f)
        return StructType(list(fields.values())).json()

    def _add(self, kind: StructType, files: list[dict]) -> dict:
        for _ in range(TRIES):
            old = self.manifest()
            try:
                return self._commit(old, self._merged(old["schema"], kind), files, [])
            except VersionTaken:
                continue
        raise VersionTaken(old["version"] + 1)

    def _write(self, df: DataFrame) -> tuple[str, list[dict]]:
        run = f"run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        return run, self._files(run)

    def _files(self, folder: str) -> list[dict]:
        return [{"name": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen()} for s in self.fs.listStatus(self._p(folder)) if s.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> dict:
        self._merged(self.manifest()["schema"], df.schema)  # before anything is written
        return self._add(df.schema, self._write(df)[1])

    def append_arrivals(self, df: DataFrame, arrivals: int) -> None:
        """As ``arrivals`` appends, of which each is a version, in one scan of ``df``."""
        run, part = uuid.uuid4().hex, f"arrival{uuid.uuid4().hex}"
        self._merged(self.manifest()["schema"], df.schema)
        df.withColumn(part, (F.monotonically_increasing_id() % arrivals).cast("int")).write.option("compression", "zstd").partitionBy(part).parquet(f"{self.path}/run-{run}")
        folders = [s.getPath().getName() for s in self.fs.listStatus(self._p(f"run-{run}")) if s.isDirectory() and s.getPath().getName().startswith(part)]
        for folder in sorted(folders) or [None]:
            self._add(df.schema, self._files(f"run-{run}/{folder}") if folder else [])

    def _tier(self, size: int) -> int:
        tier = 0
        while size * self.fanout**tier < self.target and tier < 40:
            tier += 1
        return tier

    def compact(self) -> dict:
        """Merge until no tier below the target has ``fanout`` shards."""
        while True:
            old = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for shard in old["shards"]:
                if shard["bytes"] < 0.75 * self.target:
                    tiers.setdefault(self._tier(shard["bytes"]), []).append(shard)
            ready = [t for t, s in tiers.items() if len(s) >= self.fanout]
            if not ready:
                return old
            merged = tiers[max(ready)]
            files = max(1, round(sum(s["bytes"] for s in merged) / self.target))
            run, new = self._write(self._read(old["schema"], merged).coalesce(files))
            if not self._replace(old, [s["name"] for s in merged], new):
                remove(self.spark, f"{self.path}/{run}")

    def _replace(self, old: dict, gone: list[str], new: list[dict]) -> bool:
        for _ in range(TRIES):
            try:
                self._commit(old, old["schema"], new, gone)
                return True
            except VersionTaken:
                old = self.manifest()
                if not set(gone) <= {s["name"] for s in old["shards"]}:
                    return False  # another compaction took them
        return False

    def expire(self, keep: int = 1) -> int:
        """Drop all but the newest ``keep`` versions and the shards that only older ones name; how
        many shards went. Not for use while versions to be dropped are read."""
        versions = self.versions()
        stay, drop = versions[-keep:], versions[:-keep]
        if not drop:
            return 0
        named = {s["name"] for v in stay for s in self.manifest(v)["shards"]}
        gone = {s["name"] for v in drop for s in self.manifest(v)["shards"]} - named
        self._publish(self.manifest(stay[0]), "OVERWRITE")  # in full, for the versions that it builds on go
        for version in drop:
            self.fs.delete(self._p(f"manifest-{version:012d}.json"), False)
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")
        return len(gone)

    def _read(self, schema: str | None, shards: list[dict]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        if not shards:
            return self.spark.sql("select 1").where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{s['name']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an older one."""
        now = self.manifest(version)
        return self._read(now["schema"], now["shards"])
