"""Operator 8: token counts with overlap resynchronisation for huge documents.

A text of up to ``chunk_chars`` characters is encoded whole. A longer one is encoded in chunks
that overlap. Each chunk is encoded with offsets; two neighbours are spliced at a boundary that
both have inside their overlap and that is proven stable, and where none exists the overlap is
doubled until there is one or the rest of the document is one chunk.

A boundary p is stable if both encodings have one there and what the vocabulary does before p
can't depend on what stands after it, nor the other way round:

- byte-level pre-tokens that start with a space: a pre-token ends at p, after a character that isn't
  white space. The pre-tokeniser matches from p on without regard to what stands before; the left
  chunk sees the characters at and after p.
- pre-tokens without white space: one starts at p, after a space or newline.
- sentencepiece, if no piece of the vocabulary has a space after another character: a piece starts
  with the space at p, after a character that isn't one, so no merge goes across.

Besides, none of the vocabulary's special strings begins before p and ends beyond it, or begins at
or after p without fitting into the left chunk's sight. Other vocabularies prove no boundary; their
texts are encoded whole, ``n_splices`` is 0.

Defined results: null and empty texts count 0 bytes and 0 tokens; rows with equal or null ids are
counted one by one; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from .shared import default_tokenizer, slices
from .tokens import piece_encoder

CHUNK_CHARS, OVERLAP_CHARS = 16_384, 1_024
_SPM_SPACE = "\u2581"


def _crosses(text: str, p: int, specials: list[str]) -> bool:
    """Whether a special string lies across position p."""
    return any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in specials)


class Chunks:
    """Encodings with their stable boundaries by the tokenizers library."""

    def __init__(self, tok, mode: str, specials: list[str]):
        self.tok, self.mode, self.specials = tok, mode, specials
        self.provable = mode in ("spaced", "bare")

    def encode(self, text: str) -> tuple[list[int], dict[int, int]]:
        """(ids, place in the text of each boundary -> index of the token that starts there).

        Offsets leave out the space before a word, hence for pre-tokens with a space the end of
        the one before is used."""
        encoding = self.tok.encode(text, add_special_tokens=False)
        words, offsets, out = encoding.word_ids, encoding.offsets, {}
        for k in range(1, len(words)):
            if words[k] != words[k - 1]:
                p = offsets[k - 1][1] if self.mode == "spaced" else offsets[k][0]
                if 0 < p and (text[p - 1] in " \n" if self.mode == "bare" else not text[p - 1].isspace()):
                    out[p] = k
        return encoding.ids, out


class Pieces:
    """The same by sentencepiece."""

    specials: list[str] = []

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        across = re.compile(f"[^{_SPM_SPACE}]{_SPM_SPACE}")
        self.provable = not any(across.search(self.model.id_to_piece(k)) for k in range(self.model.get_piece_size()))

    def encode(self, text: str) -> tuple[list[int], dict[int, int]]:
        found = self.model.encode(text, return_type="offset_mapping")
        starts = {p: k for k, (piece, (p, _)) in enumerate(zip(found["pieces"], found["offsets"], strict=True)) if p and piece.startswith(_SPM_SPACE)}
        return found["ids"], {p: k for p, k in starts.items() if text[p] == " " and not text[p - 1].isspace() and text[p - 1] != _SPM_SPACE}


def resync_ids(text: str, chunks, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[bytes, int]:
    """(ids as little-endian unsigned 32-bit integers, number of splices) of a whole text."""
    longest = max(map(len, chunks.specials), default=0)
    out, splices = [], 0
    begin, end = 0, min(len(text), chunk)  # of the left chunk
    left, skip = chunks.encode(text[begin:end]), 0  # tokens of the left chunk that lie before the last splice
    while end < len(text):
        wide = overlap
        while True:
            start = max(begin, end - wide)
            stop = min(len(text), start + max(chunk, 2 * wide))
            if start == begin:  # nothing in common: the two become one chunk
                stop = min(len(text), end + max(chunk, end - begin))
                left, end = chunks.encode(text[begin:stop]), stop
                break
            right = chunks.encode(text[start:stop])
            a, b = {begin + p: k for p, k in left[1].items()}, {start + p: k for p, k in right[1].items()}
            both = [p for p in a.keys() & b.keys() if start < p <= end - longest - 1 and a[p] >= skip and not _crosses(text, p, chunks.specials)]
            if both:
                p = max(both)
                out.append(array("I", left[0][skip : a[p]]).tobytes())
                left, skip, begin, end = right, b[p], start, stop
                splices += 1
                break
            wide *= 2
    out.append(array("I", left[0][skip:]).tobytes())
    return b"".join(out), splices


@lru_cache(maxsize=4)
def chunk_encoder(path: str):
    if path.endswith(".model"):
        return Pieces(path)
    coder = piece_encoder(path)
    return Chunks(coder.tok, coder.mode, coder.specials)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_splices of every document's whole text.

    ``tokenizer``: a .json file of the tokenizers library or a .model of sentencepiece.
    """
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")

    def count(batches):
        import pyarrow as pa

        chunks = chunk_encoder(path)
        short = (lambda t: len(chunks.model.encode(t))) if path.endswith(".model") else lambda t: len(piece_encoder(path).ids(t)) // 4

        def number(t):
            if len(t) <= chunk_chars or not chunks.provable:
                return short(t), 0
            ids, n = resync_ids(t, chunks, chunk_chars, overlap_chars)
            return len(ids) // 4, n

        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = [number(t) for t in texts]
            n = [c[0] for c in counts]
            yield pa.record_batch({
                "doc_id": part.column(0),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([c > limit for c in n], pa.bool_()),
                "n_splices": pa.array([c[1] for c in counts], pa.int64()),
            })

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_splices long")
