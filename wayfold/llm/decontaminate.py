"""Operator 2: benchmark decontamination with CGK embeddings and bit-sampling LSH.

Texts are sequences of words (lower case, without marks at the ends). A document leaks an item of
n words if some run of its words is within ``rate * n`` word edits of the item.

1. Count filter, without loss: k edits leave at least n - 2 - 3k of an item's n - 2 three-word
   shingles, so only places are looked at from which on, in n + k words, that many shingles of the
   items of a size class stand (for short items, n - k single words). Before the first of these at
   most 3k words of the item can stand, hence windows begin at all places up to 3k words before.
2. Windows there, as long as the shortest item of a size class, are embedded by the CGK random
   walk: step j writes the current word and moves on if a random function of (j, word) says so.
   A few edits leave most positions of the embedding alike, so edit distance becomes Hamming
   distance.
3. Repetitions sample a few positions each, from one of several walks; equal samples are candidates.
   Each size class has the repetitions that its own items need: TRIALS of them are edited at the full
   rate by substitutions, by insertions, by deletions and by a mixture, and repetitions are added
   until the worst of the four reaches the target recall. A class that can't reach it is an error.
4. Candidates are verified by exact edit distance of the item to the best run of words near it.

Different item texts are dealt to blocks by hash; each block's index is a file in the shared folder.
Documents are scanned once, never shuffled, and a task holds one block at a time, so neither the
number of items nor a passage that very many documents share makes a hot spot; no document's text
leaves its row. Items with equal texts are one until the end, where each of their ids gets a row.

Defined results: null, empty and blank documents and items match nothing; equal items are found
each; rows with equal ids are judged one by one; extra columns are ignored (``leaks``) or pass
by (``decontaminate``); an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import AtomicFile, materialise, read_file, scratch, slices

RATE, RECALL = 0.2, 0.98
#: Most positions of a sample; walks; rounds of them until fewer positions are sampled.
SAMPLED, WALKS, ROUNDS = 3, 4, 16
#: Trials of each kind of edits in each size class; words by which windows of trials are off at most.
TRIALS, NEAR = 200, 6
#: Documents searched side by side, as numbers of words only; windows embedded at once.
TOGETHER, WINDOWS = 1_024, 100_000
BLOCK_ITEMS, BLOCK_CHARS, TABLE_BITS, CLASSES = 2_048, 8_000_000, 20, 64
_MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…*_#|-–—"
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LEAK = "doc_id long, item_id long, item_words long, edits long, start_word long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash of its plain form, 0 if nothing is left; emptied when it is large."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        plain = word.lower().strip(_MARKS)
        value = self[word] = (xxh64_intdigest(plain) or 1) if plain else 0
        return value


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    words = (text or "").split()
    out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return out[out != 0]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all three-word runs."""
    if len(words) < 3:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return _mix(words[:-2] * np.uint64(3) + _mix(words[1:-1]) * np.uint64(5) + _mix(words[2:] ^ _A) * np.uint64(7))


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, walk: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rows ``wanted`` (default: all) of the 2 * size positions of the CGK embeddings of the runs of
    ``size`` words from each start; words from ``ends`` on are blank."""
    rows = {j: k for k, j in enumerate(range(2 * size) if wanted is None else wanted.tolist())}
    length, last = np.minimum(ends - starts, size), len(words) - 1
    at, out = np.zeros(len(starts), np.int64), np.zeros((len(rows), len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(max(rows, default=-1) + 1):
            x = np.where(at < length, words[np.minimum(starts + at, last)], np.uint64(0))
            if j in rows:
                out[rows[j]] = x
            step = _mix(x + np.uint64((walk * 1_000_003 + j) * 2 + 1) * _B) & np.uint64(1)
            at += step.astype(np.int64)
    return out


def edited(words: np.ndarray, edits: int, kind: str, rng) -> np.ndarray:
    """``words`` after exactly so many edits at different places: sub, ins, del, or a third of each (mix)."""
    kinds = [("sub", "ins", "del")[k % 3] if kind == "mix" else kind for k in range(edits)]
    change = dict(zip(rng.choice(len(words), edits, replace=False).tolist(), kinds, strict=True))
    new, out = iter(rng.integers(1, 1 << 62, edits, dtype=np.uint64).tolist()), []
    for k, word in enumerate(words.tolist()):
        what = change.get(k)
        if what in ("sub", "ins"):
            out.append(next(new))
        if what in (None, "ins"):
            out.append(word)
    return np.array(out, np.uint64)


def best_run(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(least edits between the item and any run of the region, end of the first such run)."""
    across = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - across) + across
    end = int(np.argmin(row))
    return int(row[end]), end


class SizeClass:
    """Items of similar length: their walks, and for each repetition the sorted samples of all."""

    def __init__(self, members: list[int], items: list[np.ndarray], rate: float, recall: float):
        sizes = [len(items[k]) for k in members]
        self.members, self.size, self.longest, self.edits = np.array(members), min(sizes), max(sizes), int(rate * max(sizes))
        least = min(n - 2 - 3 * int(rate * n) for n in sizes)  # no monotone function of n, so each size counts
        self.need, self.by_word = (least, False) if least >= 1 else (min(n - int(rate * n) for n in sizes), True)
        self.reach = self.longest + self.edits - (0 if self.by_word else 2)
        self.before = self.edits * (1 if self.by_word else 3)
        words = [items[k] for k in members]
        self.samples = self._samples(words, rate, recall)
        self.walks: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        flat, ends = np.concatenate(words), np.cumsum(sizes)
        for walk, chosen in enumerate(self.samples):
            wanted = np.unique(np.concatenate(chosen))
            embedded, tables = embed(flat, ends - sizes, ends, self.size, walk, wanted), []
            for c in chosen:
                rows = np.searchsorted(wanted, c)
                keys = sample_keys(embedded, rows)
                order = np.argsort(keys, kind="stable")
                tables.append((rows, keys[order], self.members[order]))
            self.walks.append((wanted, tables))

    def _trials(self, words: list[np.ndarray], rate: float):
        """Texts with edited items: (all words, starts and ends of the items, starts of the windows
        and the first window of each trial, trials by kind). Windows begin up to NEAR words from the
        run, as far as the count filter lets them."""
        rng, texts, items, starts, first, here = np.random.default_rng(7), [], [], [], [], 0
        tried = [words[k * len(words) // TRIALS] for k in range(TRIALS)]
        for kind in ("sub", "ins", "del", "mix"):
            for w in tried:
                run = edited(w, int(rate * len(w)), kind, rng)
                kept = np.isin(run, w) if self.by_word else np.isin(shingles(run), shingles(w))
                last = int(np.argmax(kept)) if len(kept) else 0
                near = [k for k in range(-NEAR, NEAR + 1) if last - self.before <= k <= last]
                blank = rng.integers(1, 1 << 62, NEAR + self.size, dtype=np.uint64)
                texts += [w, blank[:NEAR], run, blank[NEAR:]]
                first.append(len(starts))
                items += [(here, here + len(w))] * len(near)
                starts += [here + len(w) + NEAR + k for k in near]
                here += sum(map(len, texts[-4:]))
        return np.concatenate(texts), np.array(items), np.array(starts), np.array(first)

    def _samples(self, words: list[np.ndarray], rate: float, recall: float) -> list[list[np.ndarray]]:
        """Positions of each repetition of each walk: as few as find ``recall`` of the trials in the worst
        kind of edits, and as many positions at once as still reach that in ROUNDS rounds of walks."""
        flat, items, starts, first = self._trials(words, rate)
        for sampled in range(SAMPLED, 0, -1):
            rng, found, out = np.random.default_rng(1_000 * self.size + sampled), np.zeros(len(first), bool), [[] for _ in range(WALKS)]
            for _ in range(1 if sampled > 1 else 64):
                new = [[rng.choice(2 * self.size, sampled, replace=2 * self.size < sampled) for _ in range(ROUNDS)] for _ in range(WALKS)]
                hits = np.zeros((ROUNDS, len(first)), bool)
                for walk, chosen in enumerate(new):
                    wanted = np.unique(np.concatenate(chosen))
                    same = embed(flat, items[:, 0], items[:, 1], self.size, walk, wanted) == embed(flat, starts, starts + self.size, self.size, walk, wanted)
                    for k, c in enumerate(chosen):
                        hits[k] |= np.logical_or.reduceat(same[np.searchsorted(wanted, c)].all(0), first)
                for k in range(ROUNDS):
                    found |= hits[k]
                    out = [o + [n[k]] for o, n in zip(out, new, strict=True)]
                    if found.reshape(4, -1).mean(1).min() >= recall:
                        return out
        raise ValueError(f"items of {self.size} words don't reach a recall of {recall} at a rate of {rate}")


def sample_keys(embedded: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number for the words that each window has at the sampled positions."""
    out = np.zeros(embedded.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k, row in enumerate(rows):
            out = _mix(out * np.uint64(31) + embedded[row] + np.uint64(k + 1))
    return out


class ItemIndex:
    """Everything that a task needs of a block of items, given as (key, text)."""

    def __init__(self, items: list[tuple[str, str | None]], rate: float = RATE, recall: float = RECALL):
        memo = WordHashes()
        self.rate = rate
        self.items = [(i, w) for i, t in items if len(w := word_hashes(t, memo))]
        classes: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            classes.setdefault(min(CLASSES - 1, int(math.log(len(w)) / math.log(1.15))), []).append(k)
        self.classes = [SizeClass(members, [w for _, w in self.items], rate, recall) for members in classes.values()]
        self.places: list[tuple[np.ndarray, np.ndarray]] = []  # of shingles and of words: where, bits of classes
        for what in (shingles, lambda w: w):
            bits: dict[int, int] = {}
            for c, of in enumerate(self.classes):
                for k in of.members.tolist():
                    for h in (what(self.items[k][1]) & np.uint64((1 << TABLE_BITS) - 1)).tolist():
                        bits[h] = bits.get(h, 0) | 1 << c
            self.places.append((np.fromiter(bits, np.int64, len(bits)), np.fromiter(bits.values(), np.uint64, len(bits))))
        self._open()

    def _open(self) -> None:
        self.lists = [w.tolist() for _, w in self.items]
        self.tables = [np.zeros(1 << TABLE_BITS, np.uint64) for _ in self.places]
        for table, (where, bits) in zip(self.tables, self.places, strict=True):
            table[where] = bits

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lists", "tables")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def find(self, texts: list[np.ndarray], first_only: bool = False) -> list[list[tuple[int, int, int]]]:
        """For each text (place in items, edits, end of the run) of its leaks, the best run of each item."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not self.items or not sizes.sum():
            return [[] for _ in texts]
        words, ends = np.concatenate(texts), np.cumsum(sizes)
        mask, hits = np.uint64((1 << TABLE_BITS) - 1), []
        runs = self.tables[0][shingles(words) & mask]
        for k in (1, 2):  # shingles don't go on in the next text
            cross = ends[:-1] - k
            runs[cross[(cross >= 0) & (cross < len(runs))]] = 0
        for bits in (runs, self.tables[1][words & mask] if any(c.by_word for c in self.classes) else runs[:0]):
            at = np.flatnonzero(bits)
            hits.append((at, bits[at], np.searchsorted(ends, at, "right")))
        for c, of in enumerate(self.classes):
            at, bits, owner = hits[of.by_word]
            mine = (bits >> np.uint64(c)) & np.uint64(1) > 0
            at, owner = at[mine], owner[mine]
            stop = np.minimum(at + of.reach, ends[owner])
            enough = np.searchsorted(at, stop) - np.arange(len(at)) >= of.need
            at, owner = at[enough], owner[enough]
            if len(at):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.maximum(at - of.before, (ends - sizes)[owner]), 1)
                np.add.at(edge, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge) > 0)
                for cut in range(0, len(starts), WINDOWS):
                    self._search(of, words, ends, sizes, starts[cut : cut + WINDOWS], out, first_only)
        return [[(m, c, e) for m, (c, e) in sorted(d.items())] for d in out]

    def _search(self, of: SizeClass, words, ends, sizes, starts, out: list[dict], first_only: bool) -> None:
        """Candidates of the windows from ``starts`` on, verified into ``out``."""
        owner = np.searchsorted(ends, starts, "right")
        place, pairs = starts - (ends - sizes)[owner], [np.zeros(0, np.int64)]
        for walk, (wanted, tables) in enumerate(of.walks):
            embedded = embed(words, starts, ends[owner], of.size, walk, wanted)
            for rows, keys, members in tables:
                got = sample_keys(embedded, rows)
                low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                k = np.flatnonzero(high > low)
                n = high[k] - low[k]
                each = np.repeat(k, n)
                member = members[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[k], n)]
                pairs.append(np.unique((((owner[each] << 17) | member) << 34) | place[each]))  # texts, items and words are fewer
        pairs = np.unique(np.concatenate(pairs))
        group = pairs >> 34
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            text, member = int(group[first]) >> 17, int(group[first]) & 0x1FFFF
            item, best = self.items[member][1], out[text]
            most = int(self.rate * len(item))
            if best.get(member, (most + 1,))[0] == 0 or first_only and best:
                continue
            spans: list[list[int]] = []  # places close to one another are looked at together
            for at in (pairs[first:last] & ((1 << 34) - 1)).tolist():
                begin, end = max(0, at - 3 * most - 1), at + len(item) + 3 * most + 1
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([begin, end])
            base = int(ends[text] - sizes[text])
            for begin, end in spans:
                region = words[base + begin : min(base + end, int(ends[text]))]
                there = set(region.tolist())
                if sum(map(there.__contains__, self.lists[member])) < len(item) - most:
                    continue  # each word that isn't there is an edit
                cost, stop = best_run(item, region)
                if cost <= most and (cost, begin + stop) < best.get(member, (most + 1, 0)):
                    best[member] = (cost, begin + stop)


# --- blocks of items --------------------------------------------------------------------------


def different_items(benchmark: DataFrame) -> DataFrame:
    """key, text of each different text that isn't null."""
    text = F.col("text").cast("string")
    return benchmark.select(F.md5(text.cast("binary")).alias("key"), text.alias("text")).where("text is not null").distinct()


def index_files(benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> tuple[str, list[str]]:
    """(folder, names) of the indexes of all items, a file for each block; blocks hold about
    BLOCK_ITEMS items and BLOCK_CHARS characters on average, and equal texts once."""
    items = materialise(different_items(benchmark), "different-items")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks, folder = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS)), scratch(benchmark.sparkSession, "item-index")

    def build(key, table):
        index = ItemIndex(sorted(zip(table["key"].to_pylist(), table["text"].to_pylist(), strict=True)), rate, recall)
        out = AtomicFile(folder, f"block-{key[0].as_py():06d}", ".index")
        out.write(pickle.dumps(index))
        return pa.table({"name": pa.array([out.close()]), "block": pa.array([key[0].as_py()], pa.int64())})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, blocks))))
    made = materialise(dealt.groupBy("block").applyInArrow(build, "name string, block long"), "item-blocks")
    return folder, [r["name"] for r in made.orderBy("block").collect()]


@lru_cache(maxsize=2)
def _index(folder: str, name: str) -> ItemIndex:
    with read_file(folder, name) as f:
        return pickle.loads(f.read())


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """One row per document and item that it leaks: LEAK."""
    folder, names = index_files(benchmark, rate, recall)
    found = "doc_id long, key string, item_words long, edits long, start_word long"

    def run(batches):
        memo, kinds = WordHashes(), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for part in slices(batches, TOGETHER):
            texts, ids = [word_hashes(t.as_py(), memo) for t in part.column(1)], part.column(0).to_pylist()
            for name in names:
                index = _index(folder, name)
                rows = [(doc, index.items[m][0], len(index.items[m][1]), edits, max(0, end - len(index.items[m][1]))) for doc, some in zip(ids, index.find(texts), strict=True) for m, edits, end in some]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in found.split(", ")])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, found)
    ids = benchmark.select(F.md5(F.col("text").cast("string").cast("binary")).alias("key"), F.col("item_id").cast("long").alias("item_id"))
    return rows.join(ids, "key").select(*[f.split()[0] for f in LEAK.split(", ")])


def leak_column(text, index: tuple[str, list[str]]):
    """A boolean column: whether a text leaks any item of the indexes that ``index_files`` made."""
    from pyspark.sql.functions import arrow_udf

    folder, names = index

    @arrow_udf("boolean")
    def leaky(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = WordHashes()
        for part in parts:
            out: list[bool] = []
            for at in range(0, len(part), TOGETHER):
                texts = [word_hashes(t.as_py(), memo) for t in part.slice(at, TOGETHER)]
                found = [False] * len(texts)
                for name in names:
                    found = [a or bool(b) for a, b in zip(found, _index(folder, name).find(texts, True), strict=True)]
                out += found
            yield pa.array(out, pa.bool_())

    return leaky(text.cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """The documents, with all their columns, that leak no item."""
    return docs.where(~leak_column(docs["text"], index_files(benchmark, rate, recall)))
