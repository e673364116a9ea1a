"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: A-Z are lower-cased, words are runs of other characters than ASCII white space,
``words``-word shingles are hashed with XXH64 (seed 42), and a bit is 1 if it is set in over half
the hashes, repeats included. Two documents link if their fingerprints differ in ``radius`` bits at
most; a component is what links reach.

Search, over distinct fingerprints only, so copies are one row from there on:

1. a bounded sample gives the correlation of bits; correlated bits are put into the same part, so
   that skew stays in few parts and the others select well;
2. with m parts, two fingerprints within ``radius`` have a part i that differs in at most T[i] bits
   for any T of which the sum is radius - m + 1 and T[i] >= -1 (-1: the part is left out). Dynamic
   programming picks T for the least sum of probes and estimated candidates, and the best m;
3. every fingerprint is indexed under its own part values and probes all values within T[i];
   candidates are checked bit by bit inside the join, so only links leave it.

Part values that very many fingerprints share get a pivot, the member with the most documents.
Members and probes within ``radius`` of it link to it and needn't be compared with each other, for
they are connected already. All others are compared with those that also agree in one of
``radius`` + 1 sections of the other bits, in which any two within ``radius`` do. No pair of different
components is lost and no group is expanded into all pairs.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
rows with equal doc_id count as one each; null doc_ids stay null and never become a component's
id unless all of its ids are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, slices

WORDS, RADIUS, SEED, BITS = 5, 4, 42, 64
SAMPLE, HOT_ROWS, BROADCAST_ROWS = 1_024, 512, 10_000
#: Cost of checking a candidate against that of shuffling a probe.
CHECK_COST = 0.03
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text in its order, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that over half the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (long) of every document's whole text."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            yield pa.record_batch({"doc_id": part.column(0), "fp": pa.array([fingerprint(t, words) for t in part.column(1).to_pylist()], pa.int64())})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the plan -----------------------------------------------------------------------------------


def group_bits(planes: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of about equal size: each starts with the bit that is most correlated with those
    left, and takes the bits most correlated with it so far."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(planes.T))) if len(planes) > 2 else np.zeros((BITS, BITS))
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = -(-len(left) // (m - k))
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def signed_mask(bits) -> int:
    """Signed 64-bit number with just these bits."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks of at most ``radius`` of the bits."""
    return [signed_mask(c) for r in range(radius + 1) for c in combinations(bits, r)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """T with sum ``total`` and the least cost; costs[i][t + 1] is that of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                key, value = used + k - 1, cost + more
                if key not in step or value < step[key][0]:
                    step[key] = (value, [*chosen, k - 1])
        best = step
    return best.get(total, (float("inf"), []))


def plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part in use, for ``n`` distinct fingerprints."""
    planes = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    chosen = (float("inf"), [])
    for m in range(1, radius + 3):
        parts, costs = group_bits(planes, m), []
        for bits in parts:
            x = planes[:, bits]
            apart = np.rint(x @ (1 - x.T) + (1 - x) @ x.T).astype(int)
            pairs = np.bincount(apart[np.triu_indices(len(x), 1)], minlength=BITS + 1) if len(x) > 1 else np.zeros(BITS + 1)
            row = [0.0]
            for t in range(min(radius, 2) + 1):
                probes = sum(comb(len(bits), r) for r in range(t + 1))
                share = max(pairs[: t + 1].sum() / max(1, pairs.sum()), probes / 2.0 ** len(bits))
                row.append(n * (probes + CHECK_COST * n * share))
            costs.append(row)
        cost, thresholds = allocate(costs, radius - m + 1)
        if cost < chosen[0]:
            chosen = (cost, [(b, t) for b, t in zip(parts, thresholds, strict=True) if t >= 0])
    return chosen[1]


# --- the search ---------------------------------------------------------------------------------


def _value(bits: list[int], fp: str = "fp"):
    """The bits of a part, in their places: one operation, as terms for each bit make plans that
    take the driver hundreds of MB to analyse and compile."""
    return F.col(fp).bitwiseAND(F.lit(signed_mask(bits)).cast("long"))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between different fingerprints of ``distinct`` (fp, n_docs, doc), in which
    every two fingerprints within ``radius`` are connected."""
    n = distinct.count()
    spark = distinct.sparkSession
    sample = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()]
    chosen = plan(np.array(sample, np.int64).view(np.uint64), n, radius) if n > 1 else []
    if not chosen:
        return spark.createDataFrame([], "a long, b long")
    index = distinct.select("fp", "n_docs", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _value(bits).alias("key")) for k, (bits, _) in enumerate(chosen)])).alias("at")).select("at.part", "at.key", F.col("fp").alias("b"), "n_docs")
    masks = [F.struct(F.lit(k).alias("part"), F.lit(x).cast("long").alias("mask")) for k, (bits, t) in enumerate(chosen) for x in ball(bits, t)]
    values = F.array(*[_value(bits) for bits, _ in chosen])
    probes = distinct.select("fp", values.alias("v"), F.explode(F.array(*masks)).alias("at")).select("at.part", F.col("v")[F.col("at.part")].bitwiseXOR(F.col("at.mask")).alias("key"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    expected = max(n / 2.0 ** len(bits) for bits, _ in chosen)
    hot = materialise(index.groupBy("part", "key").agg(F.count("*").alias("rows"), F.max_by("b", F.struct("n_docs", "b")).alias("pivot")).where(F.col("rows") > max(HOT_ROWS, 16 * expected)).drop("rows"), "hot-values")
    n_hot = hot.count()
    if not n_hot:
        return probes.join(index.drop("n_docs"), ["part", "key"]).where(near & (F.col("a") < F.col("b"))).select("a", "b")
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)

    def flagged(df: DataFrame, fp: str) -> DataFrame:
        close = F.col("pivot").isNotNull() & (F.bit_count(F.col(fp).bitwiseXOR(F.col("pivot"))) <= radius)
        return df.join(hot, ["part", "key"], "left").withColumn("close", close)

    sections = []  # of each part: the other bits, dealt out evenly
    for bits, _ in chosen:
        others = [b for b in range(BITS) if b not in bits]
        sections.append([others[k :: radius + 1] for k in range(radius + 1)])

    def sectioned(df: DataFrame, fp: str) -> DataFrame:
        """A row for each section of a hot value's member, one row for any other."""
        values = F.array(*[F.array(*[_value(bits, fp) for bits in of]) for of in sections])
        wanted = F.when(F.col("pivot").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.element_at(values, F.col("part") + 1))
        return df.select("part", "key", fp, "close", F.col("pivot").isNull().alias("cold"), F.posexplode(wanted).alias("section", "value"))

    # one join for all: each branch of a union would take the driver another plan, its broadcasts and its shuffles
    left, right = flagged(probes, "a"), flagged(index.drop("n_docs"), "b")
    stars = left.where("close and a <> pivot").select(F.col("pivot").alias("a"), F.col("a").alias("b"))  # probes hold each own value too
    meets = F.when(F.col("cold") | F.col("close"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    left = sectioned(left, "a").withColumn("b_close", F.explode(meets)).drop("close")  # close ones never meet each other
    right = sectioned(right, "b").drop("cold").withColumnRenamed("close", "b_close")
    once = F.when(F.col("cold"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    return left.join(right, ["part", "key", "section", "value", "b_close"]).where(near & once).select("a", "b").unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    each = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(each.groupBy("fp").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("doc")), "distinct-fingerprints")
    linked = materialise(components(fingerprint_links(distinct, radius)), "fingerprint-roots")
    roots = linked.join(distinct.withColumnRenamed("fp", "node"), "node")
    first = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = linked.join(first, "root").select(F.col("node").alias("fp"), "component_id")
    alone = distinct.where("n_docs > 1").join(linked.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("doc").alias("component_id"))
    named = materialise(of.unionByName(alone), "components")
    return each.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
