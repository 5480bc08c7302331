"""Compressed sparse rows in plain numpy, with Gustavson's row product.

Row i of a matrix holds columns `at[first[i]:first[i + 1]]` with `value` at the same places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from llm.arrays import ragged

# Expanded entries of a product that are held at a time.
CELLS = 2_000_000


def _starts(owner: np.ndarray, rows: int) -> np.ndarray:
    """Where each owner's entries begin, in order of the owners, plus the total."""
    return np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))]


@dataclass
class CSR:
    first: np.ndarray
    at: np.ndarray
    value: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @classmethod
    def of_owner(cls, owner: np.ndarray, rows: int) -> CSR:
        """The incidence of `rows` owners and the places of `owner`, which never falls: entry
        (owner[p], p) is one."""
        return cls(_starts(owner, rows), np.arange(len(owner)), np.ones(len(owner), np.int64), len(owner))

    def transposed(self) -> CSR:
        row = np.repeat(np.arange(self.rows), np.diff(self.first))
        if np.all(self.at[1:] >= self.at[:-1]):
            return CSR(_starts(self.at, self.width), row, self.value, self.rows)
        order = np.argsort(self.at, kind="stable")
        return CSR(_starts(self.at, self.width), row[order], self.value[order], self.rows)

    def expanded(self, other: CSR) -> np.ndarray:
        """How many entries the product of each row expands to, before equal columns are added up."""
        size = np.r_[0, np.cumsum(np.diff(other.first)[self.at])]
        return size[self.first[1:]] - size[self.first[:-1]]

    def product(self, other: CSR, cells: int = CELLS) -> Iterator[tuple[int, CSR]]:
        """Blocks of whole rows of self @ other as (first row, block). Row i of the product is the sum
        of the rows of `other` that row i names, weighted by its values. A block expands to about
        `cells` entries, or is one row that is cut by its own entries."""
        weight = self.expanded(other)
        ends = np.cumsum(weight)
        row = 0
        while row < self.rows:
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + cells, "right")))
            yield row, self._rows(other, row, end)
            row = end

    def _rows(self, other: CSR, row: int, end: int) -> CSR:
        a, b = self.first[row], self.first[end]
        names, weights = self.at[a:b], self.value[a:b]
        size = other.first[names + 1] - other.first[names]
        places = ragged(other.first[names], size)
        owner = np.repeat(np.repeat(np.arange(end - row), np.diff(self.first[row : end + 1])), size)
        key = owner * other.width + other.at[places]
        value = np.repeat(weights, size) * other.value[places]
        if len(key) > 1 and not np.all(key[1:] >= key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, value = key[new], np.add.reduceat(value, new) if len(new) else value
        return CSR(np.searchsorted(key, np.arange(end - row + 1) * other.width), key % max(other.width, 1), value, other.width)
