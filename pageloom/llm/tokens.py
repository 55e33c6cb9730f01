"""Token ids of whole texts by a vocabulary file, with a memory of pieces seen before.

A byte-level BPE merges within pieces only, and a piece's ids do not depend on its
neighbours. So a text is cut into pieces as the file's own rule says, and the library is
asked once for each new piece. Characters outside a plain set might be classed differently
by another library, so stretches that hold one go to the library as they are, from one
single space between words to another; pieces never cross such a space. Files with another
rule go to the library whole. The ids are the same either way.

The memory has two generations. A full young one becomes the old one, whose pieces come
back when they are met again, so that frequent pieces stay and rare ones go.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np
from tokenizers import Tokenizer

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ž"
NUMBERS = "0-9²³¹¼-¾"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e¡-¿×÷‐-‧{LETTERS}]*")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = re.compile(rf"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
LOWERED = re.compile(rf"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
MEMORY = 250_000  # pieces of a generation


def byte_table() -> dict[int, str]:
    """Printable stand-ins for the bytes: themselves where printable, else the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Pieces(dict):
    """Pieces of the young generation to their ids as bytes, filled by the library."""

    def __init__(self, model, wide: bool):
        super().__init__()
        self.tokenize, self.kind, self.table = model.tokenize, "I" if wide else "H", byte_table()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece[1:].isalpha() and piece[0] >= " ":  # a word: only a blank in front of it changes
                shown = "Ġ" + piece[1:] if piece[0] == " " else piece
            else:
                shown = piece.encode("utf-8").decode("latin-1").translate(self.table)
            ids = array(self.kind, [t.id for t in self.tokenize(shown)]).tobytes()
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts, as arrays of ``dtype``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.pieces = Pieces(self.library.model, self.dtype == "<u4")
        before, normal = config["pre_tokenizer"] or {}, config["normalizer"]
        steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
        self.lower = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        spaced = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None
        self.rule = LOWERED if self.lower else SPACED if spaced else None

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if self.rule is None:
            return self._by_library(text)
        if PLAIN.fullmatch(text):
            return self._by_pieces(text)
        parts = []
        for plain, words in groupby(BETWEEN_WORDS.split(text), lambda w: PLAIN.fullmatch(w) is not None):
            stretch = (" " if parts else "") + " ".join(words)
            parts.append(self._by_pieces(stretch) if plain else self._by_library(stretch))
        return np.concatenate(parts)

    def _by_pieces(self, text: str) -> np.ndarray:
        found = self.rule.findall(text.lower() if self.lower else text)
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), dtype=self.dtype)

    def _by_library(self, text: str) -> np.ndarray:
        text = text.encode("utf-8", "replace").decode("utf-8")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker, so that its memory serves all tasks there."""
    return Encoder(path)
