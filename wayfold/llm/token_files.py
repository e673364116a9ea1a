"""Operator 3: token ids in files, coded by a canonical length-limited Huffman code.

The code comes from the global counts of all ids. A file holds independent blocks of ids; each
block lists the bit offset of every ``STEP``-th id, so a block, or any step of one, is decoded
without what stands before it, and numpy decodes all steps side by side with one table look-up
per id.

File: b"WFID1", then a little-endian header length and JSON header (deflated code lengths follow
it), then the blocks, then a deflated JSON footer, its length in 4 bytes, b"WFID1". Footer: for
each block its place, bytes, ids and payload bytes; then each document's id and number of ids.
Block: the uint16 bit lengths of all its steps, then the bits, most significant first.

Stages: (1) texts are encoded, ids are written to a shared table with their number; (2) ids are
counted per task, then summed, giving at most one row for each id of the vocabulary; (3) rows are
ranged by doc_id and written, a task's rows to one file; (4) files are read back, any number of
tasks at once. The table of files is published by Spark's committer, so the files of lost or
repeated attempts don't count.

Codes have at most MAX_BITS bits, or as many as the number of different ids needs, up to 24.

Defined results: a null or empty text has the end id alone. Documents with equal ids follow one
another in the order of a hash of their coded ids, and may lie in several files; null ids come first.
An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import AtomicFile, default_tokenizer, materialise, read_file, remove_strays, slices, task_id
from .tokens import piece_encoder

MAGIC, STEP, BLOCK, MAX_BITS = b"WFID1", 128, 65_536, 16
FILE_IDS = 16_000_000


# --- the code -----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, or of as many as the ids need
    (package-merge); 0: not coded."""
    used = np.flatnonzero(counts)
    limit = max(limit, (len(used) - 1).bit_length())
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if limit > 24:
        raise ValueError(f"{n} ids don't fit into codes of 24 bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, items = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        items, is_leaf = both[at], at < n
    levels.append(is_leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(levels):
        k = int(flags[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    per_length = np.bincount(lengths[order])
    at = 0
    for bits in range(1, len(per_length)):
        code <<= bits - last
        last, k = bits, int(per_length[bits])
        codes[order[at : at + k]] = code + np.arange(k, dtype=np.uint32)
        code, at = code + k, at + k
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, bits) for each value of the next bits, as many as the longest code has, MAX_BITS at least."""
    most = max(MAX_BITS, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (most - lengths[order].astype(np.int64))
    ids, bits = np.repeat(order, spans), np.repeat(lengths[order], spans)
    rest = (1 << most) - len(ids)
    return np.concatenate([ids, np.zeros(rest, ids.dtype)]).astype(np.uint32), np.concatenate([bits, np.ones(rest, bits.dtype)]).astype(np.int64)


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """Checkpoints and bits of one block."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    marks = np.append(starts[::STEP], ends[-1])
    # each code lies in one 64-bit word or goes on in the next; codes don't overlap, so sums are unions
    word, room = starts >> 6, 64 - (starts & 63) - bits
    code = codes[ids].astype(np.uint64)
    here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(here, first)
    over = np.flatnonzero(room < 0)  # at most one code goes over into each word
    out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return np.diff(marks).astype("<u2").tobytes() + out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8]


def decode_blocks(blocks: list[tuple[bytes, int]], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of several blocks, given each with its number of ids."""
    symbol, width = table
    starts, sizes, payloads, base = [], [], [], 0
    for data, n in blocks:
        steps = -(-n // STEP)
        marks = np.frombuffer(data, "<u2", steps).astype(np.int64)
        payload = data[2 * steps :]
        starts.append(base + np.cumsum(marks) - marks)
        size = np.full(steps, STEP)
        size[-1] = n - STEP * (steps - 1)
        sizes.append(size)
        payloads.append(payload)
        base += 8 * len(payload)
    bits = np.frombuffer(b"".join(payloads) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (bits[:-3] << 24) | (bits[1:-2] << 16) | (bits[2:-1] << 8) | bits[3:]
    most = len(symbol).bit_length() - 1
    at, size = np.concatenate(starts), np.concatenate(sizes)
    out = np.zeros((len(at), STEP), np.uint32)
    last, mask = len(window) - 1, (1 << most) - 1
    for k in range(STEP):
        peek = (window[np.minimum(at >> 3, last)] >> (32 - most - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = symbol[peek]
        at = at + width[peek]
    return out[np.arange(STEP) < size[:, None]]


# --- the files ----------------------------------------------------------------------------------


class IdFile:
    """Writes documents one after another; holds one block and the list of documents."""

    def __init__(self, folder: str, stem: str, lengths: np.ndarray):
        self.file, self.lengths, self.codes = AtomicFile(folder, stem, ".wfid"), lengths, canonical_codes(lengths)
        packed = zlib.compress(lengths.tobytes())
        head = json.dumps({"step": STEP, "block": BLOCK, "max_bits": MAX_BITS, "vocabulary": len(lengths), "lengths": len(packed)}).encode()
        self.file.write(MAGIC + struct.pack("<I", len(head)) + head + packed)
        self.docs, self.sizes, self.blocks, self.pending, self.held, self.total = [], [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.total += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        stop = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for k in range(0, stop, BLOCK):
            part = ids[k : min(k + BLOCK, stop)]
            data = encode_block(part, self.lengths, self.codes)
            self.blocks.append([self.file.written, len(data), len(part)])
            self.file.write(data)
        self.pending, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> str:
        self._flush(True)
        foot = zlib.compress(json.dumps({"blocks": self.blocks, "docs": self.docs, "sizes": self.sizes}).encode())
        self.file.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        return self.file.close()


def read_ids(folder: str, name: str, together: int = 8):
    """(doc_id, ids) of each document of a file, in its order; holds a few blocks at once."""
    with read_file(folder, name) as f:
        size = f.size()
        f.seek(size - 9)
        tail = f.read(9)
        if tail[4:] != MAGIC:
            raise ValueError(f"{name} isn't complete")
        n = struct.unpack("<I", tail[:4])[0]
        f.seek(size - 9 - n)
        foot = json.loads(zlib.decompress(f.read(n)))
        f.seek(len(MAGIC))
        head = json.loads(f.read(struct.unpack("<I", f.read(4))[0]))
        lengths = np.frombuffer(zlib.decompress(f.read(head["lengths"])), np.uint8)
        table, blocks = decode_table(lengths), iter(foot["blocks"])
        held, have, done = [], 0, False
        for doc, want in zip(foot["docs"], foot["sizes"], strict=True):
            while have < want and not done:
                some = []
                for _, (place, length, ids) in zip(range(together), blocks):
                    f.seek(place)
                    some.append((f.read(length), ids))
                done = not some
                if some:
                    held.append(decode_blocks(some, table))
                    have += len(held[-1])
            ids = np.concatenate(held) if len(held) != 1 else held[0]
            yield doc, ids[:want]
            held, have = [ids[want:]], have - want


# --- the stages ---------------------------------------------------------------------------------


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian; 2 bytes each if the vocabulary allows it)."""

    def encode(batches):
        import pyarrow as pa

        coder = piece_encoder(tokenizer)
        kind = "<u2" if max(coder.vocab_size, end_id + 1) <= 65_536 else "<u4"
        end = array("I", [end_id]).tobytes()
        for part in slices(batches):
            rows = [np.frombuffer(coder.ids(t or "") + end, "<u4") for t in part.column(1).to_pylist()]
            yield pa.record_batch({
                "doc_id": part.column(0),
                "n_tokens": pa.array([len(r) for r in rows], pa.int64()),
                "ids": pa.array([r.astype(kind).tobytes() for r in rows], pa.binary()),
            })

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<u2")


def id_counts(table: DataFrame) -> dict[int, int]:
    """Global counts. A task sends one row per id, so the driver gets a vocabulary's rows at most."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for part in slices(batches):
            # all documents of a slice at once: an array as long as the vocabulary for each is slow
            got = np.bincount(_ids(b"".join(part.column(1).to_pylist()), sum(part.column(0).to_pylist())))
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = table.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files to a folder of their own; returns their table: part, name, n_docs, n_ids, start (ids before it)."""
    path = tokenizer or default_tokenizer("word_bpe_49k.json")
    table = materialise(token_table(docs, path, end_id), "token-ids")
    counts = id_counts(table)
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    for k, n in counts.items():
        dense[k] = n
    lengths = code_lengths(dense)
    files = max(1, -(-sum(counts.values()) // file_ids))

    def write(batches):
        import pyarrow as pa

        out, part_id = None, task_id()
        try:
            for part in slices(batches):
                for doc, n, blob in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    out = out or IdFile(folder, f"part-{part_id:06d}", lengths)
                    out.add(doc, _ids(blob, n))
            if out:
                name = out.close()
                yield pa.record_batch({"part": pa.array([part_id], pa.int64()), "name": [name], "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([out.total], pa.int64())})
        except BaseException:
            if out:
                out.file.abort()
            raise

    # equal rows differ in their place only, so that many of them don't go to one file
    keyed = table.withColumns({"hash": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(files, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place")
    made = materialise(ranged.select("doc_id", "n_tokens", "ids").mapInArrow(write, "part long, name string, n_docs long, n_ids long"), "token-files")
    remove_strays(docs.sparkSession, folder, made)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file only
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, uint32) of all documents, decoded from the files."""
    return _read(files, folder, lambda ids: {"ids": [x.astype("<u4").tobytes() for x in ids]}, "ids binary")


def token_file_digests(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, decoded from the files."""

    def digest(ids):
        import pyarrow as pa

        return {"ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())}

    return _read(files, folder, digest, "ids_crc32 long")


def _read(files: DataFrame, folder: str, more, schema: str) -> DataFrame:
    def read(batches):
        import pyarrow as pa

        def batch(docs, starts, ids):
            return pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array([len(x) for x in ids], pa.int64())} | more(ids))

        for part in batches:
            for name, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                docs, starts, ids, held = [], [], [], 0
                for doc, x in read_ids(folder, name):
                    docs.append(doc), starts.append(at), ids.append(x)
                    at, held = at + len(x), held + len(x)
                    if held >= 1_000_000 or len(docs) >= 2_000:
                        yield batch(docs, starts, ids)
                        docs, starts, ids, held = [], [], [], 0
                if docs:
                    yield batch(docs, starts, ids)

    n = max(1, files.count())
    return files.select("name", "start").repartition(n).mapInArrow(read, f"doc_id long, start long, n_tokens long, {schema}")

