import numpy as np
import pytest

from llm import op12_whitening as op


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 3) for i, v in rows], "vec_id long, embedding array<float>, whitened double, n int")


def brute(rows, components=32):
    """Whitening by a dense eigenvalue solver."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return x, ((n * x - s) ** 2).sum(1), centred @ u / np.sqrt(e), e / np.square(centred).sum() * n


def run(spark, rows):
    df = frame(spark, rows)
    return op.whiten(df, op.fit(df.select("embedding"))).collect()


def table_of(got):
    out = {}
    for r in got:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


@pytest.mark.parametrize("dims, n", [(5, 40), (40, 300)])
def test_equals_a_dense_solver(spark, dims, n):
    rng = np.random.default_rng(dims)
    values = rng.normal(size=(n, dims)) * np.linspace(3, 0.2, dims) @ rng.normal(size=(dims, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(values.astype(np.float32))]
    bad = [(900, None), (901, []), (902, [float("nan")] * dims), (903, [1.0, None] + [0.0] * (dims - 2)), (904, [float("inf")] * dims)]
    _, deviation, white, explained = brute(rows)
    got = table_of(run(spark, rows + bad))
    assert sorted(got) == list(range(n))
    k = min(dims, 32)
    mine = np.array([[got[i][c + 1].whitened for c in range(k)] for i in range(n)])
    assert np.allclose(np.abs(mine), np.abs(white), atol=1e-8)
    assert np.allclose(mine.T @ mine / n, np.eye(k), atol=1e-9)
    assert [got[i][1].deviation for i in range(n)] == deviation.tolist()
    assert np.allclose([got[0][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert all(r.n == n and r.identity_error < 1e-9 for r in got[0].values())


def test_badly_conditioned_and_deficient_columns(spark):
    """One dimension repeats another, one is constant, and scales span nine orders of magnitude."""
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 200))
    rows = [(i, [float(x) * 1e6, float(x) * 1e6, 7.5, float(y) * 1e-1, float(z) * 1e-1]) for i, (x, y, z) in enumerate(zip(a, b, c))]
    got = table_of(run(spark, rows))
    assert {len(v) for v in got.values()} == {3}
    mine = np.array([[got[i][k].whitened for k in (1, 2, 3)] for i in range(200)])
    assert np.allclose(mine.T @ mine / 200, np.eye(3), atol=1e-6)
    assert got[0][1].identity_error < 1e-4


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(4)
    short, long = rng.normal(size=(30, 3)).astype(np.float32), rng.normal(size=(50, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(short)] + [(100 + i, v.tolist()) for i, v in enumerate(long)]
    got = table_of(run(spark, rows))
    assert {len(got[i]) for i in range(30)} == {3} and {len(got[100 + i]) for i in range(50)} == {6}
    assert got[0][1].n == 30 and got[100][1].n == 50


def test_repeated_rows_null_ids_and_no_variance(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(20, 2)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(values)] + [(3, values[3]), (None, values[4])]
    got = run(spark, rows)
    assert len(got) == 2 * 22 and sum(r.vec_id == 3 for r in got) == 4 and sum(r.vec_id is None for r in got) == 2
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert run(spark, [(1, [1.0, 2.0])]) == []
    assert run(spark, []) == []


def test_deviation_is_exact_beyond_longs(spark):
    rows = [(0, [1e6, 0.0]), (1, [-1e6, 1.0]), (2, [3.0, 2.0])]
    x, deviation, _, _ = brute(rows)
    assert [table_of(run(spark, rows))[i][1].deviation for i in range(3)] == deviation.tolist()
    huge = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [3.0, 2.0])]
    got = table_of(run(spark, huge))
    assert got[0][1].deviation is None and got[2][1].whitened is not None


def test_triangular_solve():
    rng = np.random.default_rng(6)
    r = np.triu(rng.normal(size=(70, 70))) + 10 * np.eye(70)
    x = rng.normal(size=(9, 70))
    assert np.allclose(op.triangular(x, r) @ r, x)
