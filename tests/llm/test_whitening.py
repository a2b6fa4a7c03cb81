"""Embedding whitening against exact arithmetic, clustered spectra and edge cases."""

from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

rng = np.random.default_rng(13)


def by_hand(rows):
    """{width: (n, sums, whole numbers by id, eigenvalues, eigenvectors)} of (id, vector) rows, with exact moments."""
    out = {}
    good = [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    for w in {len(x) for _, x in good}:
        own = [(i, x) for i, x in good if len(x) == w]
        fit = [list(t) for t in {tuple(x) for _, x in own}]
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        z = [[Fraction(n * c - s, n) for c, s in zip(x, sums)] for x in fit]
        v = np.array([[float(sum(a[i] * a[j] for a in z) / n) for j in range(w)] for i in range(w)])
        value, vector = np.linalg.eigh(v)
        out[w] = (n, sums, own, value[::-1], vector[:, ::-1])
    return out


def test_whitening_equals_brute_force(spark):
    base = rng.normal(scale=0.3, size=(60, 6)) * np.array([1, 2, 3, 4, 5, 6])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100, rows[0][1]), (100, rows[1][1]), (None, rows[2][1]), (101, [c + 1e-6 for c in rows[3][1]])]  # copies, a repeated id, a null id
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [])]
    rows += [(300 + i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(20, 2)))]  # another width
    df = spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows], "vec_id long, embedding array<double>, n int, x string, component string")
    got = whitening.whiten(df, components=4).collect()
    want = by_hand(rows)
    assert len(got) == sum(len(own) * min(4, w) for w, (_, _, own, _, _) in want.items())
    assert {r.vec_id for r in got}.isdisjoint({200, 201, 202, 203, 204})
    for w, (n, sums, own, value, vector) in want.items():
        k = min(4, w)
        names = {i for i, _ in own}
        have = sorted((r for r in got if r.vec_id in names), key=lambda r: (r.component, r.vec_id is None, r.vec_id or 0, r.whitened))
        assert {r.n for r in have} == {n} and len({r.identity_error for r in have}) == 1 and have[0].identity_error < 1e-12
        for c in range(1, k + 1):
            mine = [r for r in have if r.component == c]
            table = [(i, sum((n * x - s) ** 2 for x, s in zip(v, sums)), float(np.dot(np.array([float(Fraction(n * x - s, n)) for x, s in zip(v, sums)]), vector[:, c - 1]) / value[c - 1] ** 0.5)) for i, v in own]
            sign = 1 if sum(t[2] * r.whitened for t in table for r in mine if r.vec_id == t[0]) > 0 else -1
            table = sorted(((i, d, sign * y) for i, d, y in table), key=lambda t: (t[0] is None, t[0] or 0, t[2]))
            assert [(r.vec_id, r.deviation) for r in mine] == [t[:2] for t in table]
            assert np.allclose([r.whitened for r in mine], [t[2] for t in table], rtol=0, atol=1e-10)
            assert np.allclose([r.explained for r in mine], value[c - 1] / value.sum(), rtol=1e-9)


@pytest.mark.parametrize("values", [np.r_[[5.0] * 5, 3 + 1e-9 * np.arange(5), 2 + 1e-12 * np.arange(5), np.linspace(0, 1, 25)], np.ones(40), np.r_[np.ones(20), np.zeros(20)], 10.0 ** -np.arange(40), np.r_[1 + 1e-6 * np.arange(20), 1e-6 * np.arange(20)]])
def test_refinement_of_clustered_eigenvalues(values):
    """Residuals and orthogonality at double precision, from float32 eigenvectors, whatever the gaps."""
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    value, x = whitening.eigen(a)
    wide = x.astype(np.longdouble)
    assert np.abs(np.sort(values)[::-1] - value).max() < 1e-14
    assert np.abs(wide.T @ wide - np.eye(40)).max() < 2e-15
    assert np.abs(a @ wide - wide * value).max() < 5e-15
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(start.T @ start - np.eye(40)).max() > 1e-8  # so the correction is needed


def test_close_pair_is_separated():
    """Two eigenvalues 1e-9 apart, which float32 can't tell apart, get their own vectors."""
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0].astype(np.longdouble)
    values = np.array([2 + 1e-9, 2, 1, 0.9, 0.5, 0.4, 0.3, 0.1])
    a = (q * values) @ q.T
    _, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(np.abs(q.T @ x) - np.eye(8)).max() < 1e-8


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0  # no variance, no component
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None]), (3, [])], kind)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], kind)).collect()  # rank one
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    large = whitening.whiten(spark.createDataFrame([(i, [1e9 * i, 3e38, float(i * i)]) for i in range(9)], kind)).collect()
    assert {r.component for r in large} == {1} and max(r.identity_error for r in large) < 1e-4


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in whitening.whiten(df.repartition(k)).collect()) for k in (1, 7))
    assert one == many
