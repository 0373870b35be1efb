"""Token ids by the ``tokenizers`` library, with a bounded memo of space-delimited pieces.

Both vocabularies split a text before byte-pair merging, and that split never joins text across a
space unless white space stands on both sides of it. So the ids of a text are the concatenation of the ids
of its pieces, and each distinct piece is merged once per worker. The memo changes speed only: beyond
its bound, pieces are encoded again. Texts for which the argument doesn't hold (longer white space in
a byte-level vocabulary), texts with the string of one of the vocabulary's special tokens, and pieces with unusual
characters go through the library's full encoder, which takes such a string as that token.
"""

from __future__ import annotations

import json
import re
import struct

import regex

# The split patterns that the two public vocabularies declare.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# A space between white space on both sides (or the end): only there can a match of the split run over it.
_INNER_SPACE = re.compile(r" (?!\S)(?<=\s )")
_STOPS = frozenset(".,!?;:")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
MEMO_ENTRIES = 300_000
_LOADED: dict[str, "PieceEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter; others are numbered from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """A dict that computes missing entries and keeps them while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < MEMO_ENTRIES:
            self[key] = value
        return value


class PieceEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            declared = json.load(f)
        self.letters = byte_letters()
        self.model = self.full.model
        added = [t["content"] for t in declared.get("added_tokens") or [] if t["content"]]
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        words = "Lowercase" in json.dumps(declared["normalizer"])
        if words and WORD_SPLIT in [p.get("pattern", {}).get("Regex") for p in declared["pre_tokenizer"].get("pretokenizers", [])]:
            self.split, self.lead = regex.compile(WORD_SPLIT), ""
        elif not words and declared["normalizer"] is None and declared["pre_tokenizer"].get("use_regex"):
            self.split, self.lead = regex.compile(BYTE_SPLIT), " "
        else:
            self.split, self.lead = None, ""
        self.lower = words
        self.units = _Memo(self._unit)
        self.first = _Memo(lambda p: self._piece(p))
        self.later = _Memo(lambda p: self._piece(self.lead + p)) if self.lead else self.first

    def whole(self, text: str) -> bytes:
        ids = self.full.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable() or _PLAIN.fullmatch(piece)):
            return self.whole(piece)
        if self.lower:
            piece = piece.lower()
        bare = piece.removeprefix(self.lead)
        if bare.isalpha():
            return self.units[piece]
        if bare[-1:] in _STOPS and bare[:-1].isalpha():
            return self.units[piece[:-1]] + self.units[piece[-1]]
        return b"".join(map(self.units.__getitem__, self.split.findall(piece)))

    def encode(self, text: str) -> bytes:
        if self.split is None or (self.special and self.special.search(text)) or (self.lead and _INNER_SPACE.search(text)):
            return self.whole(text)
        pieces = text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))


def encoder(path: str) -> PieceEncoder:
    """One encoder per vocabulary file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
