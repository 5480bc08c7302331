"""Suffix arrays and common prefixes of many short texts at once, by induced sorting.

All texts ("lanes") of a call lie end to end in one array; each ends with a symbol that
is the smallest and occurs once in it. Steps that depend on each other inside a text run
over all lanes together, so a step is a few numpy calls however many texts there are.
"""

from __future__ import annotations

import numpy as np

from llm.arrays import ragged


def _induce(sa: np.ndarray, larger: np.ndarray, smaller: np.ndarray, base: np.ndarray, size: np.ndarray,
            heads: np.ndarray, tails: np.ndarray) -> None:
    """Places larger-type suffixes from the left and smaller-type ones from the right.
    `sa` holds places in the text, its length where there is none yet; `larger` and `smaller` give the bucket of the
    suffix one to the left of a place if it is of that type, else -1. Lanes are ordered by falling size."""
    heads, tails = heads.copy(), tails.copy()
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(longest), "left").tolist()  # lanes longer than i
    for i in range(longest):
        at = sa[base[: alive[i]] + i]
        key = larger[at]
        go = key >= 0
        key = key[go]
        head = heads[key]
        sa[head] = at[go] - 1
        heads[key] = head + 1
    ends = base + size - 1
    for i in range(longest):
        at = sa[ends[: alive[i]] - i]
        key = smaller[at]
        go = key >= 0
        key = key[go]
        tail = tails[key] - 1
        sa[tail] = at[go] - 1
        tails[key] = tail


def suffix_arrays(text: np.ndarray, size: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Suffix array of every lane, end to end, as positions inside the lane.

    `size`: length of every lane, falling. `alphabet`: symbols of lane g are below alphabet[g].
    """
    total, lanes = len(text), len(size)
    base = np.cumsum(size) - size
    lane = np.repeat(np.arange(lanes), size)
    last = base + size - 1
    # Smaller-type: smaller than the suffix that follows.
    step = np.zeros(total, np.int64)
    step[:-1] = np.sign(text[1:] - text[:-1])
    step[last] = 1
    differs = np.where(step != 0, np.arange(total), total)
    small = step[np.minimum.accumulate(differs[::-1])[::-1]] > 0
    leftmost = small.copy()
    leftmost[1:] &= ~small[:-1]
    leftmost[base] = False
    leftmost[last] |= size > 1
    bucket = np.cumsum(alphabet) - alphabet
    own_bucket = bucket[lane] + text
    counts = np.bincount(own_bucket, minlength=int(alphabet.sum()))
    tails = np.cumsum(counts)
    heads = tails - counts
    tails, heads = tails.astype(np.int32), heads.astype(np.int32)
    left = np.full(total + 1, -1, np.int32)
    left[1:total] = own_bucket[:-1]
    left[base] = -1
    left_small = np.r_[False, small]
    larger, smaller = np.where(left_small, np.int32(-1), left), np.where(left_small, left, np.int32(-1))
    larger[total] = smaller[total] = -1
    marks = np.flatnonzero(leftmost)

    def placed(order: np.ndarray) -> np.ndarray:
        """`order`: leftmost-smaller positions, those of one bucket in rising order."""
        sa = np.full(total, total, np.int32)
        key = own_bucket[order]
        rank = np.argsort(key, kind="stable")
        key, order = key[rank], order[rank]
        n = np.bincount(key, minlength=len(counts))
        within = np.arange(len(key)) - (np.cumsum(n) - n)[key]
        sa[tails[key] - n[key] + within] = order
        single = base[size == 1]
        sa[single] = single
        return sa

    sa = placed(marks)
    _induce(sa, larger, smaller, base, size, heads, tails)
    # Leftmost-smaller substrings in sorted order get names; equal neighbours share one.
    order = sa[leftmost[sa]]
    if not len(order):
        return sa - base[lane]
    nth = np.full(total, -1, np.int64)
    nth[marks] = np.arange(len(marks))
    stop = np.r_[marks[1:], total - 1]
    stop = np.where(lane[np.minimum(stop, total - 1)] == lane[marks], stop, marks)
    length = (stop - marks + 1)[nth[order]]
    same = np.zeros(len(order), bool)
    maybe = np.flatnonzero((length[1:] == length[:-1]) & (lane[order[1:]] == lane[order[:-1]])) + 1
    if len(maybe):
        n = length[maybe]
        one, two = ragged(order[maybe], n), ragged(order[maybe - 1], n)
        unequal = (text[one] != text[two]) | (small[one] != small[two])
        same[maybe] = ~np.logical_or.reduceat(unequal, np.cumsum(n) - n)
    own = lane[order]
    fresh = ~same
    name = np.cumsum(fresh)
    marks_of = np.bincount(own, minlength=lanes)
    first = np.cumsum(marks_of) - marks_of
    has = marks_of > 0
    start = np.zeros(lanes, np.int64)
    start[has] = name[first[has]]
    name = name - start[own]
    names_of = np.zeros(lanes, np.int64)
    names_of[has] = name[(first + marks_of - 1)[has]] + 1
    deeper = np.flatnonzero(names_of < marks_of)
    if len(deeper):
        by_place = np.zeros(total, np.int64)
        by_place[order] = name
        again = np.argsort(-marks_of[deeper], kind="stable")
        deeper = deeper[again]
        inner = ragged(first[deeper], marks_of[deeper])  # `marks` are in place order, lane after lane
        sub = suffix_arrays(by_place[marks[inner]], marks_of[deeper], names_of[deeper])
        order[inner] = marks[sub + np.repeat(first[deeper], marks_of[deeper])]
    sa = placed(order)
    _induce(sa, larger, smaller, base, size, heads, tails)
    return sa - base[lane]


def common_prefixes(text: np.ndarray, size: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every place of the suffix array, the symbols its suffix shares with the one before it in
    its lane (0 at the first). Permuted into text order, a value is one less than its left neighbour's where the
    symbols left of both suffixes are equal; only the other values are counted symbol by symbol."""
    total = len(text)
    base = np.cumsum(size) - size
    flat = np.repeat(base, size) + sa
    before = np.full(total, -1, np.int64)
    rest = np.ones(total, bool)
    rest[base] = False
    before[flat[rest]] = flat[np.flatnonzero(rest) - 1]
    opens = np.zeros(total, bool)
    opens[base] = True
    place = np.arange(total)
    counted = opens | (before < 0)
    inner = np.flatnonzero(~counted)
    counted[inner] = opens[before[inner]] | (text[inner - 1] != text[before[inner] - 1])
    permuted = np.zeros(total, np.int64)
    row = np.flatnonzero(counted & (before >= 0))
    one, two, run = row, before[row], 0
    while len(row):
        # The end symbol of a lane occurs once in it, so equal symbols never lead out of the lane.
        same = text[one] == text[two]
        permuted[row[~same]] = run
        row, one, two, run = row[same], one[same] + 1, two[same] + 1, run + 1
    source = np.maximum.accumulate(np.where(counted, place, 0))
    return (permuted[source] - (place - source))[flat]
