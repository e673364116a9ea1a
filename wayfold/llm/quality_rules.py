"""Operator 5: quality rules on repetition coverage.

Words of a text get numbers; rolling hashes of several n-gram lengths are computed over them in
numpy, and sorting finds those that occur twice or more. What counts is the share of the text's
word characters that lie inside a later occurrence of an n-gram (each character once, however many
n-grams cover it), and inside later copies of a line.

The base figures are exact: windows of three words are compared by their word numbers, not by hash.

Defined results: null, empty and blank texts have zero figures and fail the base rule for too few
words; every row is judged by itself, so ties and repeated rows need no rule; other columns pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices

#: n-gram length -> largest share of characters in later occurrences that a kept text may have.
NGRAM_SHARES = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: The same for characters in later copies of a line.
LINE_CHARS = 0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = b" \t\n\x0b\x0c\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, line_chars_share double, line_share double, ngram_chars_share double, kept boolean"


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _occurrences(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value occurs twice or more, value has occurred before) of each position."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    again, twice = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that lie in a marked window of ``n`` words."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes | None) -> dict:
    """Figures and verdict of one UTF-8 text."""
    data = text or b""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    step = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    n, total = len(starts), int(chars.sum())
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if line.strip(_BLANK):
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode(errors="replace")) for w in line.split())
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in data.split()), np.int64, n)
    repeat = 0
    if n >= 3:
        if len(number) < 1 << 21:
            windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            windows = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True)[1]
        twice, again = _occurrences(windows)
        repeat = int(_covered(twice, 3, n).sum())
    worst, kept = 0.0, True
    if n >= min(NGRAM_SHARES) and again.any():  # a longer n-gram can't occur again if no three words do
        hashes, mixed = np.zeros(n, np.uint64), _mixed(ids)
        with np.errstate(over="ignore"):
            rolling = mixed.copy()
            for k in range(2, min(max(NGRAM_SHARES), n) + 1):
                rolling = rolling[:-1] * _MULTIPLIER + mixed[k - 1 :]
                if k in NGRAM_SHARES:
                    hashes = rolling
                    later = _occurrences(hashes)[1]
                    if not later.any():
                        break
                    share = float(chars[_covered(later, k, n)].sum()) / max(1, total)
                    worst = max(worst, share)
                    kept &= share <= NGRAM_SHARES[k]
    line_chars, line_share = dup_line_chars / max(1, total), dup_lines / max(1, lines)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": total, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed,
        "line_chars_share": line_chars, "line_share": line_share, "ngram_chars_share": worst,
        "kept": kept and not failed and line_chars <= LINE_CHARS,
    }


def rules_column(text):
    """A struct column of RULES for a text column; rows keep all their other columns."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.types import StructType

    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in RULES.split(", ")]

    @arrow_udf(StructType.fromDDL(RULES))
    def judge(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in fields], names=[name for name, _ in fields])

    return judge(text.cast("string").cast("binary"))


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id and all figures of RULES for every document."""

    def run(batches):
        for part in slices(batches):
            rows = [measure(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": part.column(0)} | {
                name: pa.array([r[name] for r in rows], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind])
                for name, kind in (f.split() for f in RULES.split(", "))
            })

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {RULES}")
