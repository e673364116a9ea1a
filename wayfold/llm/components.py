"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node, root for every end of ``links`` (a long, b long); root is the least node reachable.

    Each round attaches neighbours to the least one known, first larger then smaller ones, and is
    written to a shared table. Degrees are summed before they are shuffled, and the joins are
    plain equi-joins that Spark can split where a node has very many links. Links with a null end are
    no links; repeated ones and those of a node to itself change nothing; without links there are no rows.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialise(small.union(own.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(last, large)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
