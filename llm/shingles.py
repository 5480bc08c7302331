"""Word shingle sets of whole texts, as sorted 64-bit hashes.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lowered.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from llm.arrays import SpanHash, mix, utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word ends, first word of every row plus the total)."""
    data = _LOWER[data]
    inside = ~_BREAK[data]
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the distinct shingles of every row in ascending order.

    A row with fewer words than `size` has its whole sequence as its one shingle; a row
    without words has none.
    """
    low, starts, ends, first = words(data, offsets)
    rows = len(offsets) - 1
    hashed = SpanHash(low).spans(starts, ends)
    count = np.diff(first)
    out = np.zeros(len(hashed), np.uint64)
    # Position-dependent multiples, so that the order of the words counts.
    factors = [np.uint64(f) for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                                      0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
    for k in range(size):  # the whole slice may hold fewer words
        out[: max(len(out) - k, 0)] += hashed[k:] * (factors[k % len(factors)] + np.uint64(2 * (k // len(factors))))
    out = mix(out)
    row = np.repeat(np.arange(rows), count)
    keep = np.arange(len(out)) + size <= first[1:][row] if len(out) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    for r in short:  # at most size - 1 words each
        value = np.uint64(count[r])
        for w in hashed[first[r] : first[r + 1]]:
            value = mix(np.array([value]) * factors[0] + w)[0]
        out[first[r]], keep[first[r]] = value, True
    out, row = out[keep], row[keep]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[fresh], row[fresh]
    return out, np.searchsorted(row, np.arange(rows + 1))


# How a code point takes part in words: it separates them, it is part of one, or it is one.
_SEPARATES, _PART, _ALONE = range(3)
# Scripts that are written without spaces between words.
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"


@lru_cache(maxsize=1)
def _roles() -> np.ndarray:
    """The role of every code point: letters, marks and numbers make words, all else separates."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 32
    every = points.tobytes().decode("utf-32-le")
    out = np.full(len(points), _SEPARATES, np.uint8)
    for role, pattern in ((_PART, r"[\p{L}\p{M}\p{N}]+"), (_ALONE, _UNSPACED + "+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = role
    return out


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row plus the total): runs of letters, marks and
    numbers in lower case. In scripts without spaces each character is a word."""
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    if len(data) and data.max() >= 128:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    else:
        points, size = data, np.ones(len(data), np.int64)
    at = np.r_[0, np.cumsum(size)]
    role = _roles()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    part = role == _PART
    start = (role == _ALONE) | part & (~np.r_[False, part[:-1]][: len(part)] | edge[:-1])
    end = (role == _ALONE) | part & (~np.r_[part[1:], False][: len(part)] | edge[1:])
    start, end = at[np.flatnonzero(start)], at[np.flatnonzero(end) + 1]
    return SpanHash(data).spans(start, end), np.searchsorted(start, offsets)
