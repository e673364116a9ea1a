"""Near copies by the exact Jaccard similarity of word shingles.

Words are those of operator 4. Two documents link if the sets of their ``words``-word shingles (a
shorter text is one shingle) have a Jaccard similarity of OVER / UNDER (0.8) at least; a group is what
links reach.

1. Equal sets are one node from here on.
2. Operator 4 links the nodes' SimHash fingerprints within RADIUS bits by the generalised pigeonhole
   principle; each node has one candidate from there, its neighbour with the most documents. At 0.8
   fingerprints of 64 bits differ in about ten, a radius at which that search finds no select part,
   hence the next step finds what SimHash can't.
3. ``BANDS`` bands of ``ROWS`` MinHash values each; nodes that agree in a band can be similar. A pair of
   similarity s agrees in one with probability 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.8. Each band
   value has a pivot, the node with the most documents. A node's other candidate is the pivot that it
   meets in the most bands. Links are verified on the shingles themselves.
4. Nodes that share a band value with others that they aren't connected with by then are open. Among
   all open nodes an exact prefix join finds the rest: shingles are ordered from the rarest to the
   most frequent, and two sets can be similar only if they meet in the first few of both, at
   places that leave enough for the common part. Most members of a large group of variants are
   connected by then or have so many shingles of their own that they meet nobody; no group is
   expanded into all pairs. These candidates are verified like the others.

Defined results: null, empty and blank texts have the empty set and are one group; rows with equal
doc_id and different texts are each in their own text's group; null doc_ids never become a group's
id unless all of its ids are null; extra columns pass by in ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import free_name, materialise, slices
from .simhash import fingerprint_links, majority, shingle_hashes

WORDS, BANDS, ROWS, RADIUS, SEED = 5, 24, 6, 4, 42
#: The least similarity as a fraction.
OVER, UNDER = 4, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of a UTF-8 text."""
    return np.unique(shingle_hashes(text, words))


def _node(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(shingles.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def bands(shingles: np.ndarray) -> list[int]:
    """A 64-bit value per band, of the least values of ROWS random orders and the band's number."""
    from xxhash import xxh64_intdigest

    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 1_024):
        part = shingles[at : at + 1_024]
        np.minimum(least, (_FACTORS[:, :1] * part + _FACTORS[:, 1:]).min(1), out=least)
    raw = least.tobytes()
    return [xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash of the text, node (hash of the set), its size, SimHash fingerprint and bands."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
            keys = np.array([bands(s) if len(s) else [0] * BANDS for s in sets], np.uint64).view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.record_batch({"doc_id": part.column(0), "text_hash": part.column(1), "node": pa.array([_node(s) for s in sets], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array([majority(s) for s in sets], pa.int64()), "bands": lists})

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(run, "doc_id long, text_hash long, node long, size long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the texts of ``wanted`` (node, doc, text_hash), one row a node."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches):
            sets = [shingle_set(t, words) for t in part.column(0).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.record_batch({"node": pa.array([_node(s) for s in sets], pa.int64()), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))})

    text = docs["text"].cast("string")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    want = wanted.select(F.col("doc").alias("of"), F.col("text_hash").alias("hash"))
    found = texts.join(want, F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")), "left_semi").select("text")
    return found.mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs that are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    common, total = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
    return materialise(both.where((OVER + UNDER) * common >= OVER * total).select("a", "b"), "near-links")


def prefix_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: all pairs of ``sets`` (node, shingles) with different ``roots`` (node, root) that can be similar.

    x comes before y by size, then by node. If they are similar, x has one of its first
    |x| - ceil(2t / (1 + t) |x|) + 1 shingles, in any one order of all, among the first
    |y| - ceil(t |y|) + 1 of y, and at the first that they have in common at least t / (1 + t) (|x| + |y|)
    are left in both."""
    each = materialise(sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")), "open-shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    known = each.join(often, "shingle").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("ranked"))
    known = known.withColumn("alone", F.col("size") - F.size("ranked"))  # shingles of one node come first
    ceil = lambda over, under: F.floor((F.col("size") * over + under - 1) / under).cast("int")
    probe, index = F.col("size") - ceil(OVER, UNDER) + 1, F.col("size") - ceil(2 * OVER, OVER + UNDER) + 1
    first = known.where(probe > F.col("alone")).select("node", "size", index.alias("index"), "alone", F.posexplode(F.slice("ranked", F.lit(1), probe - F.col("alone"))).alias("k", "at"))
    first = first.select("node", "size", "index", (F.col("alone") + F.col("k")).alias("place"), F.col("at.shingle").alias("shingle")).join(roots, "node")
    first = materialise(first, "open-prefixes")
    x = first.where("place < index").select("shingle", F.col("node").alias("a"), F.col("size").alias("x_size"), F.col("place").alias("x_place"), F.col("root").alias("x_root"))
    y = first.select("shingle", F.col("node").alias("b"), F.col("size").alias("y_size"), F.col("place").alias("y_place"), F.col("root").alias("y_root"))
    before = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    fits = before & (F.col("x_root") != F.col("y_root")) & (UNDER * F.col("x_size") >= OVER * F.col("y_size")) & ((OVER + UNDER) * left >= OVER * (F.col("x_size") + F.col("y_size")))
    return x.join(y, "shingle").where(fits).select("a", "b").distinct()


def both_ways(links: DataFrame) -> DataFrame:
    """a, b: each link once in either direction; a search finds those of large groups in several parts and sections."""
    once = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return once.select(F.explode(ends).alias("at")).select("at.a", "at.b")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: each node with the main one of its fingerprint, and that with the main one of the
    neighbouring fingerprint that has the most documents."""
    nodes = nodes.where("size > 0").select("node", "n", "fp", "at.doc")
    prints = nodes.groupBy("fp").agg(F.sum("n").alias("n_docs"), F.min("doc").alias("doc"), F.max(F.struct("n", "node")).alias("main"))
    prints = materialise(prints.select("fp", "n_docs", "doc", F.col("main.node").alias("main")), "distinct-fingerprints")
    links = fingerprint_links(prints.select("fp", "n_docs", "doc"), RADIUS)
    both = both_ways(links)
    known = prints.select(F.col("fp").alias("b"), "n_docs", F.col("main").alias("other"))
    best = both.join(known, "b").groupBy("a").agg(F.max(F.struct("n_docs", "other")).alias("best"))
    across = best.join(prints.select(F.col("fp").alias("a"), F.col("main").alias("own")), "a").select(F.col("best.other").alias("a"), F.col("own").alias("b"))
    within = nodes.join(prints.select("fp", "main"), "fp").where("node <> main").select(F.col("main").alias("a"), F.col("node").alias("b"))
    return across.unionByName(within)


def _grouped(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node of every row; node, group_id, keep_doc, keep_hash)."""
    each = materialise(signatures(docs, words), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "text_hash")).alias("at")
    nodes = each.groupBy("node").agg(first, F.count("*").alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "shingle-nodes")
    close = simhash_pairs(nodes)
    rows = nodes.where("size > 0").select("node", "n", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.struct("n", "size", "node")).alias("pivot")).where("rows > 1")
    rows = materialise(rows.join(shared.select("key", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size")), "key"), "shared-bands")
    fits = UNDER * F.least("size", "pivot_size") >= OVER * F.greatest("size", "pivot_size")
    met = rows.where(F.col("node") != F.col("pivot")).where(fits).groupBy("node", "pivot").agg(F.count("*").alias("bands"))
    pairs = met.groupBy("node").agg(F.max(F.struct("bands", "pivot")).alias("best")).select(F.col("best.pivot").alias("a"), F.col("node").alias("b"))
    pairs = materialise(pairs.unionByName(close).distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(rows.select("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("at.doc", "at.text_hash")
    sets = materialise(shingle_sets(docs, wanted, words), "shingle-sets")
    links = verified(pairs, sets)
    linked = materialise(components(links), "near-roots")
    rooted = rows.select("key", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = materialise(rooted.join(mixed, "key", "left_semi").groupBy("node").agg(F.first("root").alias("root")), "open-nodes")
    more = verified(prefix_pairs(sets.join(open_, "node", "left_semi"), open_), sets)
    if not more.isEmpty():
        linked = materialise(components(links.unionByName(more)), "near-roots")
    of = nodes.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "at")
    least = of.groupBy("root").agg(F.min("at").alias("at"))
    named = of.select("node", "root").join(least, "root").select("node", F.col("at.doc").alias("group_id"), F.col("at.text_hash").alias("keep_hash"))
    return each.select("doc_id", "text_hash", "node"), materialise(named, "near-groups")


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group) of every row."""
    each, named = _grouped(docs, words)
    return each.join(named, "node").select("doc_id", "group_id")


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents, with all their columns: of each group the text with the least (doc_id, hash
    of the text), null ids last. Of rows that are equal in both, that with the least other columns stays."""
    each, named = _grouped(docs, words)
    kept = each.join(named, "node").where(F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("keep_hash")))
    kept = materialise(kept.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept-rows").select(F.col("doc_id").alias("_kept_doc"), F.col("text_hash").alias("_kept_hash"), F.col("n").alias("_kept_n"))
    names = {c: free_name(docs, c) for c in ("doc", "hash")}
    held = docs.select("*", docs["doc_id"].cast("long").alias(names["doc"]), F.xxhash64(docs["text"].cast("string")).alias(names["hash"]))

    def take(some: DataFrame) -> DataFrame:
        return held.join(some, F.col(names["doc"]).eqNullSafe(F.col("_kept_doc")) & (F.col(names["hash"]) == F.col("_kept_hash")), "left_semi")

    repeated = kept.where("_kept_n > 1")
    if repeated.isEmpty():
        return take(kept).select(*docs.columns)
    row = F.struct(*[held[c] for c in docs.columns])
    once = take(repeated).groupBy(names["doc"], names["hash"]).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return take(kept.where("_kept_n = 1")).select(*docs.columns).unionByName(once)
