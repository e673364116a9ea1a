"""Sets of ids as bitmaps: one row for each bucket of 32,768 ids, and Bloom filters of them.

A set is a table (bucket long, bits binary); set operations and counts never see single ids. A Bloom
filter has the same form over hashed places, so its parts are built and read by many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES = 4_096


def of(ids: DataFrame, column: str = "traj_id") -> DataFrame:
    return ids.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def union(*sets: DataFrame) -> DataFrame:
    both = sets[0]
    for other in sets[1:]:
        both = both.unionByName(other)
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _combined(a: DataFrame, b: DataFrame, how: str, op) -> DataFrame:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def combine(left: pa.Array, right: pa.Array) -> pa.Array:
        none = bytes(BYTES)
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([op(np.frombuffer(x, np.uint8), np.frombuffer(y or none, np.uint8)).tobytes() for x, y in pairs], pa.binary())

    other = b.select("bucket", F.col("bits").alias("other"))
    out = a.join(other, "bucket", how).select("bucket", combine("bits", "other").alias("bits"))
    return out.where(F.bitmap_count("bits") > 0)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "inner", lambda x, y: x & y)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "left", lambda x, y: x & ~y)


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    """The ids of ``universe``, a set, that ``a`` hasn't; there are no bits beyond it."""
    return difference(universe, a)


def count(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def bit(bits: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0, F.lit(False))


def has(rows: DataFrame, a: DataFrame, column: str = "traj_id", anti: bool = False) -> DataFrame:
    """Rows of which the id is in the set, or isn't. Sets join by bucket; small ones are broadcast by Spark."""
    at = rows.withColumns({"_bucket": F.bitmap_bucket_number(column), "_place": F.bitmap_bit_position(column)})
    held = at.join(a.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")), "_bucket", "left")
    inside = bit(F.col("_bits"), F.col("_place"))
    return held.where(~inside if anti else inside).drop("_bucket", "_place", "_bits")


def members(a: DataFrame) -> DataFrame:
    """traj_id of every id of the set."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<bigint>")
    def expand(buckets: pa.Array, bits: pa.Array) -> pa.Array:
        out = []
        for bucket, blob in zip(buckets.to_pylist(), bits.to_pylist(), strict=True):
            places = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8), bitorder="little"))
            out.append(((bucket - 1) * 8 * BYTES + places + 1 if bucket > 0 else bucket * 8 * BYTES - places).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return a.select(F.explode(expand("bucket", "bits")).alias("traj_id"))


# --- Bloom filters -----------------------------------------------------------------------------


def bloom_bits(n: int, p: float) -> int:
    return math.ceil(-n * math.log(p) / math.log(2) ** 2)


def bloom_hashes(n: int, bits: int) -> int:
    return math.ceil(bits // n * math.log(2))


def bloom_seeds(hashes: int, seed: int = 42) -> list[int]:
    """A seed for each hash, the same in every task and session."""
    return [seed + k for k in range(hashes)]


def _places(column: str, bits: int, seeds: list[int]) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(s), F.col(column).cast("long")), F.lit(bits)) for s in seeds])


def bloom_filter(ids: DataFrame, column: str, bits: int, seeds: list[int]) -> DataFrame:
    """bucket, bits of a Bloom filter over a column, built by partial aggregates."""
    placed = ids.select(F.explode(_places(column, bits, seeds)).alias("at"))
    return placed.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def may_contain(rows: DataFrame, bloom: DataFrame, column: str, bits: int, seeds: list[int]) -> DataFrame:
    """Rows of which the filter may hold the id: all that were put, and a share of others."""
    ids = rows.select(column).distinct().select(column, F.explode(_places(column, bits, seeds)).alias("at"))
    probes = ids.select(column, F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("place"))
    hit = F.count_if(bit(F.col("bits"), F.col("place")))
    good = probes.join(bloom, "bucket", "left").groupBy(column).agg(hit.alias("hits")).where(F.col("hits") == len(seeds))
    return rows.join(good.select(column), column, "left_semi")
