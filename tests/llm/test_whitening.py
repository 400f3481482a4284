"""Whitening against numpy in double precision and against Python's whole numbers."""

import numpy as np
import pytest

from tickscope.llm import whitening as wh

EMB = "vec_id long, embedding array<float>, component int, deviation string, w string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 4, "x", "y") for i, v in rows], EMB)


def check(found, vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(int) + 100000
    n, width = x.shape
    sums = x.sum(axis=0)
    d = n * x - sums
    v = (d / n).T @ (d / n) / n
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(k, width)
    assert len(found) == n * k and {r.n for r in found} == {n}
    assert sorted(r.deviation for r in found) == sorted([sum(int(c) ** 2 for c in row) for row in d] * k)
    for r in found:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9, abs=1e-15)
    return (d / n) @ axes[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), values


def test_same_as_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 20)) @ np.diag(np.linspace(0.2, 3, 20))).astype(np.float32).tolist()
    odd = [(900, None), (901, [NAN] + [0.0] * 19), (902, [INF] * 20), (903, [None] + [1.0] * 19), (904, []), (905, [1.0] * 19), (906, [1e30] * 20)]
    found = wh.whiten(frame(spark, [*enumerate(vectors), *odd])).collect()
    want, _ = check(found, vectors)
    got = np.zeros((300, 8))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-9 and found[0].identity_error < 1e-10


def test_repeats_ties_and_constant_dimensions(spark):
    rows = [(1, [1.0, 0.0, 5.0])] * 4 + [(None, [0.0, 2.0, 5.0])] * 3 + [(2, [0.5, 0.5, 5.0])]
    found = wh.whiten(frame(spark, rows)).collect()
    check(found, [v for _, v in rows])
    assert all((r.whitened is None) == (r.component == 3) for r in found) and found[0].identity_error < 1e-10
    same = wh.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(None, 0.0, 0, 0.0)}


def test_empty(spark):
    for rows in ([], [(1, None), (2, []), (3, [NAN])]):
        found = wh.whiten(frame(spark, rows))
        assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long(spark):
    """Large entries are counted exactly; what no long holds is null."""
    rows = [(i, [1e9 * (i % 3), 1.0]) for i in range(30)] + [(99, [2e12, 1.0])]
    found = wh.whiten(frame(spark, rows)).collect()
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    want = {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    assert {r.vec_id: r.deviation for r in found} == {i: d if d < 1 << 63 else None for i, d in want.items()}


@pytest.mark.parametrize("values", [
    np.linspace(1, 40, 40), np.r_[np.ones(5) + np.arange(5) * 1e-9, np.linspace(2, 30, 30), 50 + np.arange(5) * 1e-11],
    np.r_[np.ones(20), np.full(20, 3.0)], np.r_[np.zeros(20), np.arange(1, 21)], np.geomspace(1e-12, 1, 40)])
def test_refined_vectors(values):
    """Orthonormal and invariant to double precision, also where eigenvalues are clustered or equal; float32 alone is far from it."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((40, 40)))[0].astype(np.longdouble)
    a = (q * values.astype(np.longdouble)) @ q.T
    a = ((a + a.T) / 2).astype(float)
    found, x = wh.eigen(a)
    assert np.abs(x.T @ x - np.eye(40)).max() < 2e-15 and np.abs(a @ x - x * found).max() < 1e-14 * values.max()
    assert np.abs(found - np.linalg.eigh(a)[0][::-1]).max() < 1e-13 * values.max()
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(rough.T @ rough - np.eye(40)).max() > 1e-8
    _, wide = wh.eigen(a, extended_width=10)
    assert np.abs(wide.T @ wide - np.eye(40)).max() < 1e-14


def test_clusters():
    assert [sorted(g.tolist()) for g in wh.clusters(np.array([3.0, 1.0, 1.1, 9.0, 3.05, 1.2]), 0.15)] == [[1, 2, 5], [0, 4]]
