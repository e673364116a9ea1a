"""Exact token ids of whole texts with a memo of stable pieces.

A text is cut only where no token of the vocabulary's pre-tokeniser can lie across the cut, so
the ids of a text are the ids of its pieces one after another. Words repeat, hence most pieces
come from a memo and the library encodes each new piece once.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from functools import lru_cache

#: The pre-tokeniser pattern of the lower-casing vocabulary that drops white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Neither letters, digits nor white space: a run of these after a letter is one pre-token of both patterns.
_MARKS = string.punctuation
#: An added token of this form could lie across a word and its marks.
_WORD_AND_MARKS = re.compile(f"[^\\W\\d_]*[{re.escape(_MARKS)}]*")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    table = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class _Unclean(Exception):
    """A piece has white space at an end, so its neighbours may change it."""


class _Memo(dict):
    """Results of ``make`` by piece, in two generations of at most ``limit`` entries: a full one
    replaces the older, from which pieces that occur again come back. Long pieces aren't kept."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class PieceEncoder:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes, equal to the library's.

    mode "spaced": byte-level pre-tokens that start with a space. Between a character that isn't
    white space and " x" there is always a pre-token boundary, as white space stands only at
    the start of the pattern's alternatives. The same holds before and after a single newline
    between two such characters.
    mode "bare": white space is dropped, so every space or newline is a boundary.
    mode "whole": anything else; texts go to the library as they are.
    The memo holds at most twice ``limit`` entries, so memory is bounded.
    """

    def __init__(self, path: str, limit: int = 350_000):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        plain = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or _WORD_AND_MARKS.fullmatch(t["content"])) for t in spec["added_tokens"])
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        ends = spec["post_processor"] is None and not spec["truncation"] and not spec["padding"]
        self.mode = "whole"
        if plain and ends and not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.mode = "spaced"
        steps = pre.get("pretokenizers", [])
        if plain and ends and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == WORD_PATTERN and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"] and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.mode = "bare"
        self.letters, self.model = byte_letters(), self.tok.model
        self.memo = _Memo(self._clean if self.mode == "spaced" else self._piece, limit)
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= 20_000:
                self.words.clear()
            found = self.words[word] = self._tokenize(word)
        return found

    def _tokenize(self, word: str) -> bytes:
        if word[0] == " " and word.isascii():
            spelt = "\u0120" + word[1:]
        else:
            spelt = word if word.isascii() and word.isalpha() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece that isn't in the memo. Latin letters with any ASCII marks at the end are
        one or two pre-tokens; the model gets these at once, all else takes the library's way."""
        if not piece:
            return b"" if self.mode == "bare" else self._whole(" ")
        body = piece.rstrip(_MARKS)
        mark = piece[len(body) :]
        if self.mode == "spaced" and "\n" in piece:
            first, *rest = piece.split("\n")
            if first and all(r and not r[0].isspace() and not r[-1].isspace() for r in rest) and not first[-1].isspace():
                return self._piece(first) + b"".join(self._pretoken("\n") + self._bare(r) for r in rest)
        if not body.isalpha() or not body.isascii() and max(body) > "\xff":
            return self._whole(piece if self.mode == "bare" else " " + piece)
        if mark:
            return self.memo[body] + self._pretoken(mark)
        if self.mode == "bare":
            low = body.lower()
            return self.memo[low] if low != body else self._tokenize(body)
        return self._tokenize(" " + body)

    def _clean(self, piece: str) -> bytes:
        """A piece after a space, or after nothing if it starts with a newline."""
        if piece.isalpha() and piece.isascii():
            return self._tokenize(" " + piece)
        if not piece or piece[-1].isspace():
            raise _Unclean
        if piece[0] == "\n":
            if piece[1].isspace():
                raise _Unclean
            return self._pretoken("\n") + self._bare(piece[1:])
        if piece[0].isspace():
            raise _Unclean
        return self._piece(piece)

    def _bare(self, part: str) -> bytes:
        """As ``_piece`` for what follows a single newline."""
        body = part.rstrip(_MARKS)
        mark = part[len(body) :]
        if not body.isalpha() or not body.isascii() and max(body) > "\xff":
            return self._whole(part)
        return self._pretoken(body) + (self._pretoken(mark) if mark else b"")

    def ids(self, text: str) -> bytes:
        if self.mode == "whole" or not text:
            return self._whole(text) if text else b""
        if self.mode == "bare":
            return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))
        tail = b""
        if text[-1] == "\n" and len(text) > 1 and not text[-2].isspace():
            text, tail = text[:-1], self._pretoken("\n")
        # a single newline starts a piece; two in a row stay inside one
        first, *pieces = text.replace("\n", " \n").replace(" \n \n", "\n\n").split(" ")
        if first and not first[-1].isspace():
            try:
                return self._whole(first) + b"".join(map(self.memo.__getitem__, pieces)) + tail
            except _Unclean:
                pass
        first, *pieces = _CUT.split(text)
        return self._whole(first) + b"".join([self._piece(p[1:]) for p in pieces]) + tail


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path)
