"""Whitening against numpy's eigenvectors, exact polynomials on small matrices, and its defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import whitening as w
from runlens.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, tmp_path, rows, schema=SCHEMA, extra=None):
    df = spark.createDataFrame(rows, schema)
    df = df.withColumns(extra) if extra else df
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return op13_embedding_whitening(spark, str(tmp_path)).toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True)


def integers(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)


def compare(got, ids, vectors):
    """Against eigenvectors of the covariance of the distinct integer vectors."""
    x = integers(vectors)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(axis=0)
    off = (n * fit - s).astype(float) / n
    values, vecs = np.linalg.eigh(off.T @ off / n)
    k = min(16, int((values > 1e-9 * values.max()).sum()))
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    assert len(got) == len(ids) * k and set(got.n) == {n}
    z = ((n * x - s).astype(float) / n) @ vecs / np.sqrt(values)
    order = np.argsort(ids, kind="stable")
    mine = got.whitened.to_numpy().reshape(len(ids), k)
    z = z[order]
    signs = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine - z * signs).max() < 1e-8
    assert got.deviation.tolist() == [d for r in x[order] for d in [int(((n * r - s) ** 2).sum())] * k]
    assert np.allclose(got.explained.to_numpy()[:k], values / np.trace(off.T @ off / n), rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def test_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(300, 24)) * np.geomspace(0.2, 50, 24)).astype(np.float32)
    v[50:80] = v[10]  # copies count once in the fit list
    ids = [int(i) for i in rng.permutation(300)]
    got = run(spark, tmp_path, [(i, x.tolist(), 0) for i, x in zip(ids, v, strict=True)])
    compare(got, ids, v)


def test_fewer_dimensions_and_close_eigenvalues(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(500, 3)).astype(np.float32) * 1000
    v = np.concatenate([v, v[:, :1]], axis=1)  # a repeated dimension: one eigenvalue is 0
    got = run(spark, tmp_path, [(i, x.tolist(), 0) for i, x in enumerate(v)])
    compare(got, list(range(500)), v)


def test_equal_eigenvalues(spark, tmp_path):
    v = [[a, b, 0.0] for a in (1.0, -1.0) for b in (1.0, -1.0)]
    got = run(spark, tmp_path, [(i, x, 0) for i, x in enumerate(v)])
    assert sorted(set(got.component)) == [1, 2] and np.allclose(got.explained, 0.5) and got.identity_error.max() < 1e-12
    assert np.allclose((got.whitened.to_numpy().reshape(4, 2) ** 2).sum(axis=1), 2)


def test_defined_cases(spark, tmp_path):
    good = [[0.5, 1.0], [2.0, -1.0], [0.25, 8.0], [3.0, 3.0]]
    rows = [(i, x, 1) for i, x in enumerate(good)] + [(0, good[0], 2), (None, good[1], None), (9, None, 0), (10, [], 0), (11, [1.0, None], 0), (12, [1.0, float("nan")], 0), (13, [float("inf"), 1.0], 0), (14, [3e38, 1.0], 0), (15, [1.0], 0), (16, [1.0, 2.0, 3.0], 0)]
    got = run(spark, tmp_path, rows, extra={c: F.lit(7) for c in ("id", "x", "n", "component", "i", "v")})
    assert sorted(got.vec_id.fillna(-1).tolist()) == sorted([0.0, 0.0, 1.0, 2.0, 3.0, -1.0] * 2)
    once = got.assign(vec_id=got.vec_id.fillna(99)).drop_duplicates().sort_values(["vec_id", "component"]).reset_index(drop=True)
    compare(once, [0, 1, 2, 3, 99], [*good, good[1]])


def test_nothing_varies(spark, tmp_path):
    for k, rows in enumerate(([], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)])):
        (tmp_path / str(k)).mkdir()
        assert len(run(spark, tmp_path / str(k), rows)) == 0


def test_entries_beyond_exact_doubles(spark, tmp_path):
    rows = [(i, [2.0**40 * x, y], 0) for i, (x, y) in enumerate([(1.0, 1.0), (-2.0, 3.0), (5.0, -2.0), (0.5, 0.0)])]
    got = run(spark, tmp_path, rows, "vec_id long, embedding array<double>, label int")
    assert got.identity_error.max() < 1e-9 and set(got.component) == {1, 2}
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((4 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert got.deviation[::2].tolist() == pytest.approx([float("nan") if v >= 1 << 63 else v for v in want], nan_ok=True)


def minors(m):
    """The characteristic polynomial by Faddeev and LeVerrier, exact."""
    d = len(m)
    a, c, out = np.array(m, object), Fraction(1), [Fraction(1)]
    b = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        ab = a @ b
        c = -sum(ab[i, i] for i in range(d)) / k
        out.append(c)
        b = ab + c * np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    return [int(x) for x in reversed(out)]


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(-(10 ** (seed + 1)), 10 ** (seed + 1), size=(9, 7)).astype(object)
    f[:, 3] = f[:, 1] if seed == 2 else f[:, 3]
    m = (f.T @ f).tolist()
    assert w.characteristic_polynomial(spark, m) == minors(m)


def test_block_matrices_reduce_without_pivots(spark):
    m = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]]
    p = w.characteristic_polynomial(spark, m)
    assert p == minors(m)
    assert [(round(float(r), 12), k) for r, k in w.largest_roots(p, 4, 12)] == [(4.0, 2), (3.0, 1), (1.0, 1)]


def test_roots_are_told_apart_however_close(spark):
    # (x - 10^6)(x - 10^6 - 1)(2^40 x - 1)(2^40 x - 3) x, and a double root
    p = [1]
    for low, high in ((-(10**6), 1), (-(10**6) - 1, 1), (-1, 1 << 40), (-3, 1 << 40), (0, 1), (-7, 1), (-7, 1)):
        p = [low * a + high * b for a, b in zip([*p, 0], [0, *p], strict=True)]
    got = w.largest_roots(p, 10, 10**7)
    want = [(10**6 + 1, 1), (10**6, 1), (7, 2), (3 / 2**40, 1), (1 / 2**40, 1)]
    assert [k for _, k in got] == [k for _, k in want] and [float(r) for r, _ in got] == pytest.approx([v for v, _ in want], rel=1e-15)
    assert [k for _, k in w.largest_roots(p, 3, 10**7)] == [1, 1, 2]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (10, 10**6, 10**9):
        a = rng.integers(-top, top, size=(50, 4))
        assert w.exact_product(a, a).tolist() == (a.astype(object).T @ a.astype(object)).tolist()
