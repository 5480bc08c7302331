"""Array helpers for tasks that work on batches of whole texts.

A batch of texts becomes one byte array plus row offsets. Hashes are 64-bit
polynomials over bytes, taken from one running sum, and finished with a mixer.
Everything here is plain numpy over one slice of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text and rows that one slice of a batch holds (a longer text is a slice of its own).
SLICE_BYTES, SLICE_ROWS = 1_000_000, 1024
# The same where a step makes many arrays with eight bytes for each byte of text: a worker
# keeps what it once took, for all later steps of a job.
HASH_BYTES = 1 << 18

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below 2**bits."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        run = np.ones(1 << bits, np.uint64)
        step, have = b, 1
        while have < len(run):
            run[have : 2 * have] = run[:have] * np.uint64(step)
            step, have = step * step % (1 << 64), 2 * have
        out.append(run)
    return out[0], out[1]


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1))


class SpanHash:
    """Hashes of any spans of one byte array, in constant time each."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        bits = max(16, int(len(data) + 1).bit_length())
        base = (_ODD * (2 * seed + 1)) % (1 << 64) | 1
        powers, self._inverse = _powers(base, bits)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(seed)[data] * powers[: len(data)], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of `width` bytes."""
        n = len(self._sum) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sum[width:] - self._sum[:n]) * self._inverse[:n] + np.uint64(width))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about `most` bytes of text and SLICE_ROWS rows at most."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield batch.slice(at, end - at)
        at = end


def run_starts(values: np.ndarray) -> np.ndarray:
    """Index of the first element of every run of equal values."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 ... (count[0] of them), start[1] ...: indices of all ranges."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return shift + np.arange(total, dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of a partition that is sorted by integer `keys`, cut so that no group spans two of
    them: (rows, start of every group plus the end). Only the last group waits for the next batch, and
    batches of fewer than `least` bytes, which are put together."""
    rest: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = rows.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(b.nbytes for b in rest) < least:
            continue
        if len(rest) > 1 and all(rest[0].column(k)[0].equals(batch.column(k)[batch.num_rows - 1]) for k in keys):
            continue
        rows = pa.Table.from_batches(rest)
        starts = cut(rows)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts
        rest = rows.slice(starts[-1]).to_batches()
    if rest:
        rows = pa.Table.from_batches(rest)
        yield rows, np.r_[cut(rows), rows.num_rows]
