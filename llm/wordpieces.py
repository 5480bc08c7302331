"""The word tokenizer's text side: special strings, normal form, words, byte symbols.

Reads a `tokenizers` JSON file of the kind "BPE with word ends" (see the tokenizers'
README). Its steps are fixed values of the file format: special strings are cut out of
the raw text first; the rest is put in NFC, white space becomes one space, letters are
lowered one by one; the pattern below finds the words.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

# Code points newer than this Python's Unicode tables, and which of them the tokenizers' library does
# not count as letters or numbers although the regex module does.
_NEW = "".join(regex.findall(r"\P{Cn}", "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")))
_OTHER = {c for part, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(_NEW) for c in part} if _NEW else set()
_LATE = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", _NEW) if c in _OTHER)
# The file's word pattern, with white space as Unicode defines it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\p{{White_Space}}{L}{N}]+"
WORD = regex.compile(_PATTERN.format(L=r"\p{L}", N=r"\p{N}"))
_HIGH = re.compile(f"[{min(_NEW)}-\U0010ffff]") if _NEW else re.compile("(?!)")
_NEW_SET = frozenset(_NEW)
_NFC, _LOWER = normalizers.NFC(), normalizers.Lowercase()
# Slower, so only for texts that hold such a code point.
_LATE_WORD = regex.compile("(?V1)" + _PATTERN.format(L=rf"[\p{{L}}--[{_LATE}]]", N=rf"[\p{{N}}--[{_LATE}]]")) if _LATE else WORD
# Byte-level alphabets write these bytes as themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file's tokens."""
    plain = set(_PLAIN)
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PairTable:
    """Finds the index of a pair of small integers: an open-addressed table of int64 keys."""

    def __init__(self, first: np.ndarray, second: np.ndarray, width: int):
        self._width, self._none = width, len(first)
        self._bits = max(8, int(len(first) * 8).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._index = np.full(1 << self._bits, self._none, np.int64)
        keys = first * width + second
        slot, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self._keys[slot[waiting]] < 0]
            self._keys[slot[free]] = keys[free]
            won = free[self._keys[slot[free]] == keys[free]]
            self._index[slot[won]] = won
            waiting = np.setdiff1d(waiting, won, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of every pair; the number of pairs where there is none."""
        keys = first * self._width + second
        slot = self._slot(keys)
        out = np.where(self._keys[slot] == keys, self._index[slot], self._none)
        left = np.flatnonzero((self._keys[slot] != keys) & (self._keys[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self._bits) - 1)
            there = self._keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self._index[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Vocabulary:
    """Tokens and merges of the file as arrays.

    A symbol is a byte (0-255) or the last byte of a word (256-511); `symbol_ids` maps it
    to its token id. Merge r joins `left[r]` and `right[r]` into `made[r]`.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.symbol_ids = np.array([vocab[c] for c in letters] + [vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._ranks = PairTable(self.left, self.right, self.size)
        self.text = [""] * self.size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.text[i] = token
        cut = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self._cut = regex.compile(f"({cut})") if cut else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge that joins two tokens; len(made) where there is none."""
        return self._ranks.find(left, right)

    def words(self, text: str) -> list[str]:
        """Words and special strings in order; a special string cannot equal a word, as the
        word pattern never crosses from '|' into letters."""
        if self._cut is None or not any(s in text for s in self.specials):
            return find_words(text)
        return [w for part in self._cut.split(text) for w in ([part] if part in self.specials else find_words(part))]


def find_words(text: str) -> list[str]:
    if not text.isascii():
        if _HIGH.search(text) and not _NEW_SET.isdisjoint(text):
            return _LATE_WORD.findall(_LOWER.normalize_str(_NFC.normalize_str(text)))
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return WORD.findall(text.lower())


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words end to end, word offsets)."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    offsets = np.r_[0, np.cumsum(lengths)]
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
    flat[offsets[1:] - 1] += 256
    return flat, offsets
