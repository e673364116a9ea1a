"""Operator 9: packing documents into windows by best-fit decreasing.

A document's ids and one end id are cut into full windows of ``window`` ids; each is a sequence of
its own at once and never shuffled. The rest of a document, shorter than a window, is packed whole:
within a group, pieces go in order of decreasing length, each into the open window with the least
room that still holds it. A segment tree indexed by remaining capacity finds it in log2(window)
steps. Groups hold about ``group_pieces`` pieces by a hash of piece and row, their number grows
with the table, and only lengths and ids of pieces are shuffled, not texts or token ids. Every
group leaves a few windows with room, which costs about one window in a thousand.

Padding: a sequence is filled up to ``window`` ids, or left as it is if its length is a power of two.

Defined results: a null or empty text is the end id alone; rows with equal ids are packed one by
one; a null id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import default_tokenizer, materialise, slices, task_id
from .tokens import piece_encoder

WINDOW, GROUP_PIECES = 2_048, 8_192
_FULL = 1 << 62
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """Segment tree over remaining capacities 1..size: how many open windows have each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            self._add(room, 1)

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that an open window has."""
        count, k = self.count, need + self.leaves
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; longest first, ties in the order given."""
    tree, place, offset, windows = CapacityTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        room = tree.tightest(need)
        if room is None:
            room, at, windows = window, windows, windows + 1
        else:
            at = tree.take(room)
        place[k], offset[k] = at, window - room
        tree.put(room - need, at)
    return place, offset


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """The pieces of all documents; full windows have their sequence already."""

    def cut(batches):
        import pyarrow as pa

        coder, end, full = piece_encoder(tokenizer), array("I", [end_id]).tobytes(), _FULL + (task_id() << 36)
        for part in slices(batches, 128):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = coder.ids(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    whole = len(piece) == 4 * window
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), n, full if whole else None, 0 if whole else None, piece if with_ids else None))
                    full += whole
            if rows:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``with_ids``, the ids themselves (binary, uint32; else null)."""
    pieces = materialise(cut_documents(docs, tokenizer or default_tokenizer("byte_bpe_50k.json"), end_id, window, with_ids), "pieces")
    short = pieces.where(F.col("sequence_id").isNull())
    groups = max(1, -(-short.count() // group_pieces))

    def fit(key, table):
        import pyarrow as pa

        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")])
        at, offset = best_fit_decreasing(order["length"].to_numpy(), window)
        names = order.schema.names
        out = order.set_column(names.index("sequence_id"), "sequence_id", pa.array((key[0].as_py() << 32) + at, pa.int64())).set_column(names.index("offset"), "offset", pa.array(offset, pa.int64()))
        return out.drop_columns(["group"])

    place = F.monotonically_increasing_id()  # of the row in what was written: equal pieces go to different groups
    grouped = short.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", place), F.lit(groups)))
    placed = grouped.groupBy("group").applyInArrow(fit, PIECE)
    return pieces.where(F.col("sequence_id").isNotNull()).unionByName(placed)


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids, ids (array, padded unless its length is a power of two) from ``pack(with_ids=True)``."""

    def join(key, table):
        import pyarrow as pa

        order = table.sort_by("offset")
        ids = np.frombuffer(b"".join(order["ids"].to_pylist()), "<u4")
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(window - n, pad_id, np.uint32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_ids": pa.array([n], pa.int64()), "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    return placed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_ids long, ids array<long>")
