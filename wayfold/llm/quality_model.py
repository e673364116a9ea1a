"""Operator 10: a sparse rule ensemble as quality classifier.

Shallow trees on random halves of a labelled sample give conjunctive rules over statistics of the
text; lasso logistic regression keeps few of them; the kept rules become one Spark expression over
the statistics. Only text statistics are inputs. The sample is at most ``SAMPLE`` labelled rows, by
hash of doc_id, from rows whose crc32(doc_id as text) mod 3 isn't 1; of documents with one id one is used.

Defined results: null, empty and blank texts have zero statistics and are scored like others; with
no usable labels every score is 0.5, with one class only it is that class's smoothed share; rows
with equal ids are scored one by one; null ids are never learned from and aren't held out; extra
columns pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, slices

SAMPLE, TREES, DEPTH, BINS, LASSO, STEPS = 8_000, 40, 3, 24, 0.002, 400
STATS = ["n_words", "chars_per_word", "distinct_share", "adjacent_share", "top_share", "upper_share", "symbols_per_word", "shouts_per_word", "digit_share", "line_copy_share"]
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[list(b"#*$%&|<>")], _KIND[list(b"!")] = 3, 4


def statistics(text: bytes | None) -> list[float]:
    data = text or b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=5)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    return [float(n), chars / n, len(number) / n, float((ids[1:] == ids[:-1]).sum()) / n, float(np.bincount(ids).max()) / n, kinds[1] / chars, kinds[3] / n, kinds[4] / n, kinds[2] / chars, 1 - len(set(lines)) / len(lines)]


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and STATS."""

    def run(batches):
        for part in slices(batches):
            rows = np.array([statistics(t) for t in part.column(1).to_pylist()])
            yield pa.record_batch({"doc_id": part.column(0)} | {name: pa.array(rows[:, k]) for k, name in enumerate(STATS)})

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def _tree(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rng, out: set) -> None:
    """Split by least Gini impurity; every node but the root is a rule."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = (float("inf"), 0, 0.0)
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        v = x[rows, f]
        for cut in np.unique(np.quantile(v, np.linspace(0, 1, BINS + 2)[1:-1])):
            left = v <= cut
            k = int(left.sum())
            if 5 <= k <= len(rows) - 5:
                p, q = y[rows][left].mean(), y[rows][~left].mean()
                cost = k * p * (1 - p) + (len(rows) - k) * q * (1 - q)
                if cost < best[0]:
                    best = (cost, int(f), float(cut))
    cost, f, cut = best
    if cost == float("inf"):
        return
    left = x[rows, f] <= cut
    _tree(x, y, rows[left], depth - 1, (*path, (f, 0, cut)), rng, out)
    _tree(x, y, rows[~left], depth - 1, (*path, (f, 1, cut)), rng, out)


def fires(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) of the lasso logistic model over tree rules."""
    if len(y) == 0:
        return 0.0, []
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return bias, []
    rng, rules = np.random.default_rng(11), set()
    for _ in range(TREES):
        _tree(x, y, rng.choice(len(y), max(20, len(y) // 2)), DEPTH, (), rng, rules)
    rules = sorted(rules)
    z = np.array([fires(r, x) for r in rules], np.float64).T
    seen, keep = set(), []
    for k in range(len(rules)):  # rules that fire alike are one
        mark = z[:, k].tobytes()
        if mark not in seen:
            seen.add(mark)
            keep.append(k)
    rules, z = [rules[k] for k in keep], z[:, keep]
    w, v, b, t = np.zeros(len(rules)), np.zeros(len(rules)), bias, 1.0
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    for _ in range(STEPS):
        gap = 1 / (1 + np.exp(-(z @ v + b))) - y
        new = v - rate * (z.T @ gap) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        b -= rate * gap.mean()
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    return float(b), [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6]


def compile_score(model: tuple[float, list], stat) -> Column:
    """The score as a Spark expression; ``stat`` gives the column of a statistic by name."""
    total = F.lit(model[0])
    for rule, weight in model[1]:
        test = F.lit(True)
        for f, above, cut in rule:
            test = test & ((stat(STATS[f]) > cut) if above else (stat(STATS[f]) <= cut))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list]:
    """Learn from at most ``sample`` labelled rows; that many ids are broadcast."""
    usable = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~held_out(labels["doc_id"]))
    chosen = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    each = statistics_table(texts).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("stats"))  # of repeated ids one row
    rows = each.join(chosen, "doc_id").select("quality", "stats.*").orderBy("quality", *STATS).collect()
    x = np.array([[r[s] for s in STATS] for r in rows]).reshape(-1, len(STATS))
    return fit(x, np.array([float(r["quality"] > 0) for r in rows]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)
    scored = statistics_table(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compile_score(model, F.col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def statistics_column(text: Column) -> Column:
    """The statistics of a text column as a struct; rows keep all their other columns."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.types import DoubleType, StructField, StructType

    @arrow_udf(StructType([StructField(s, DoubleType()) for s in STATS]))
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], names=STATS)

    return run(text.cast("string").cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score 0.5 or more."""
    model, name = train(docs, labels), free_name(docs, "quality_stats")
    return docs.withColumn(name, statistics_column(docs["text"])).where(compile_score(model, lambda s: F.col(name)[s]) >= 0.5).drop(name)
