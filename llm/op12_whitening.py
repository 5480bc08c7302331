"""12. Embedding whitening by shifted Cholesky QR.

An entry c becomes the long x = floor(64 * c) + 1000000. The vectors of one length are a space of
their own: n of them, with sums S per dimension and centred rows x - S/n. Every pass is one job
that adds up Gram matrices, a partial one per task:

1. G = sum of X'X of the centred rows X; R1 is the Cholesky factor of G plus a small shift,
   which keeps it positive however badly the columns are conditioned.
2. The rows are sent through triangular solves with the factors so far (Q = X / R), and the Gram
   matrix of Q gives the next factor, until Q is orthonormal (two or three passes).
3. X = Q R, so the singular values and right vectors of R (with the root of Q's last Gram
   matrix, the identity up to rounding) are the covariance's: e = s^2 / n.

The driver only holds matrices of dimension by dimension, never rows. A last pass measures the
whitened columns' covariance.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped;
repeated rows and null ids are vectors like any other; 64 * c beyond +-2^62 counts as that bound;
directions without variance (all equal vectors, constant or repeated dimensions) are no components,
so a space without any gives no rows; a deviation beyond a long is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.tables import table

COMPONENTS, PASSES = 32, 8
_EPS = float(np.finfo(np.float64).eps)
# Rows of a slice that are worked on at a time, and columns that one triangular solve takes together.
ROWS, COLUMNS = 4096, 32
# Two 31-bit halves keep sums of longs exact.
_HALF = 31


@dataclass
class Space:
    """What is known of the vectors of one length. `centre` and `rest` split S/n into a long and a
    fraction, so that centring loses nothing."""

    n: int
    total: list[int]
    centre: np.ndarray = field(init=False)
    rest: np.ndarray = field(init=False)
    over: np.ndarray = field(init=False)
    factors: list[np.ndarray] = field(default_factory=list)
    gram: np.ndarray | None = None
    mean: np.ndarray | None = None
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    error: float = 0.0

    def __post_init__(self) -> None:
        self.centre = np.array([s // self.n for s in self.total], np.int64)
        over = [s % self.n for s in self.total]
        self.over = np.array(over, np.int64)
        self.rest = np.array([o / self.n for o in over])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n*x - S)^2, exactly."""
        gap = x - self.centre
        rough = np.square(gap.astype(np.float64) * self.n - self.over).sum(1)
        small = (rough < 2.0**62) & (np.abs(gap).max(1, initial=0).astype(np.float64) * self.n < 2.0**62)
        out = np.where(small[:, None], gap, 0) * np.int64(self.n) - np.where(small[:, None], self.over, 0)
        out = np.square(out).sum(1)
        missing = np.zeros(len(x), bool)
        for k in np.flatnonzero(~small):  # beyond what longs hold on the way
            value = sum((int(g) * self.n - int(o)) ** 2 for g, o in zip(gap[k], self.over))
            missing[k] = value >= 2**63
            out[k] = 0 if missing[k] else value
        return pa.array(out, pa.int64(), mask=missing)


def lattice(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, longs x) of the usable vectors, by length."""
    offsets = column.offsets.to_numpy()
    values = column.values
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    entries = np.where(values.is_valid().to_numpy(zero_copy_only=False), entries, np.nan)
    size = np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    bad = np.r_[0, np.cumsum(~np.isfinite(entries))]
    usable &= bad[offsets[1:]] == bad[offsets[:-1]]
    for d in np.unique(size[usable]).tolist():
        rows = np.flatnonzero(usable & (size == d))
        c = entries[offsets[rows][:, None] + np.arange(d)]
        yield rows, np.floor(np.clip(64.0 * c, -(2.0**62), 2.0**62)).astype(np.int64) + 1_000_000


def triangular(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q with q @ r = x for an upper triangular r, by blocks of columns."""
    q = x.copy()
    for a in range(0, r.shape[1], COLUMNS):
        b = min(a + COLUMNS, r.shape[1])
        q[:, a:b] -= q[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            q[:, j] -= q[:, a:j] @ r[a:j, j]
            q[:, j] /= r[j, j]
    return q


def _summed(vectors: DataFrame, cells: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """Adds up `cells(length, x)` over all usable rows. A task sends one partial sum per length and
    cell; the cells of a length are at most its square."""
    whole = kind == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                for d, x in ((x.shape[1], x) for _, x in lattice(batch.slice(a, ROWS).column(0))):
                    more = cells(d, x)
                    mine[d] = mine[d] + more if d in mine else more
        for d, total in mine.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), d, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)),
                                              pa.array(total)], ["d", "cell", "value"])

    sums = vectors.mapInArrow(run, f"d int, cell int, value {kind}").groupBy("d", "cell").agg(F.sum("value").alias("value"))
    got = sums.toArrow().sort_by([("d", "ascending"), ("cell", "ascending")])
    lengths = got.column("d").to_numpy()
    values = got.column("value").to_numpy().astype(np.int64 if whole else np.float64)
    return {int(d): values[lengths == d] for d in np.unique(lengths)}


def _square(cells: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = cells
    return out + np.triu(out, 1).T


def sums(vectors: DataFrame) -> dict[int, Space]:
    """n and S of every length, exactly."""
    def cells(d: int, x: np.ndarray) -> np.ndarray:
        return np.r_[len(x), (x >> _HALF).sum(0), (x & ((1 << _HALF) - 1)).sum(0)]

    return {d: Space(int(v[0]), [(int(h) << _HALF) + int(w) for h, w in zip(v[1 : d + 1], v[d + 1 :])])
            for d, v in _summed(vectors, cells, "long").items()}


def _gram_pass(vectors: DataFrame, spaces: dict[int, Space], rows: Callable[[Space, np.ndarray], np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(Gram matrix, column sums) of `rows(space, x)` for every length."""
    def cells(d: int, x: np.ndarray) -> np.ndarray:
        if d not in spaces:
            return np.zeros(0)
        q = rows(spaces[d], x)
        return np.r_[(q.T @ q)[np.triu_indices(q.shape[1])], q.sum(0)]

    out = {}
    for d, v in _summed(vectors, cells, "double").items():
        if d in spaces:
            k = (int(np.sqrt(8 * len(v) + 9)) - 3) // 2
            out[d] = _square(v[: k * (k + 1) // 2], k), v[k * (k + 1) // 2 :]
    return out


def _orthogonal_rows(space: Space, x: np.ndarray) -> np.ndarray:
    q = space.centred(x)
    for r in space.factors:
        q = triangular(q, r)
    return q


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray | None:
    """The next upper factor, or None where the columns are orthonormal already, except for such
    as have no length at all."""
    d = len(gram)
    least, most = (e := np.linalg.eigvalsh(gram))[0], e[-1]
    if not first and np.all((np.abs(e - 1) < 1e-11) | (np.abs(e) < 1e-18)):
        return None
    if most <= 0:
        return None
    shift = 11 * (n * d + d * (d + 1)) * _EPS * most if first or least < 0.1 * most else 0.0
    shift = min(shift, 0.01 * most)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, d * _EPS * most)


def fit(vectors: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> dict[int, Space]:
    """The whitening of every length, from one column of vectors; all rows are read in each pass."""
    spaces = sums(vectors)
    open_ = dict(spaces)
    for k in range(passes):
        if not open_:
            break
        for d, (gram, total) in _gram_pass(vectors, open_, _orthogonal_rows).items():
            space = open_[d]
            space.gram = gram
            if k == 0:
                space.mean = total / space.n  # what rounding leaves of a centred mean
            r = _factor(gram, space.n, k == 0) if k + 1 < passes else None
            if r is None:
                del open_[d]
            else:
                space.factors.append(r)
    for space in spaces.values():
        d = len(space.total)
        r = np.eye(d)
        for f in space.factors:
            r = f @ r
        e, u = np.linalg.eigh(space.gram)
        # X'X = R' G R with G the last Gram matrix.
        root = (u * np.sqrt(np.maximum(e, 0))) @ u.T
        _, s, v = np.linalg.svd(root @ r)
        space.trace = float(np.square(s).sum()) / space.n
        kept = int((s > 8 * d * _EPS * s[0]).sum()) if s[0] > 0 else 0
        kept = min(kept, components)
        space.vectors, space.values = np.ascontiguousarray(v[:kept].T), np.square(s[:kept]) / space.n
    live = {d: s for d, s in spaces.items() if len(s.values)}
    if live:
        for d, (gram, _) in _gram_pass(vectors, live, lambda s, x: s.whitened(x) - s.mean @ s.vectors / np.sqrt(s.values)).items():
            live[d].error = float(np.abs(gram / live[d].n - np.eye(len(gram))).max())
    for space in live.values():  # not needed to whiten
        space.factors, space.gram = [], None
    return live


def whiten(df: DataFrame, spaces: dict[int, Space], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component, by falling variance."""
    picked = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_v"))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                for rows, x in lattice(part.column("_v")):
                    space = spaces.get(x.shape[1])
                    if space is None:
                        continue
                    k = len(space.values)
                    each = np.repeat(np.arange(len(rows)), k)
                    yield pa.RecordBatch.from_arrays([
                        part.column("vec_id").take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(each), space.n)), space.deviation(x).take(pa.array(each)), pa.array(space.whitened(x).ravel()),
                        pa.array(np.tile(space.values / space.trace, len(rows))), pa.array(np.full(len(each), space.error))], names)

    kind = picked.schema["vec_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, fit(vectors.select("embedding")))
