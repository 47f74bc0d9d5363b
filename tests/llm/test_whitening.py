"""Whitening against exact integers and the library's eigenvalues."""

import math

import numpy as np
import pytest

from folioscope.llm import registry, whitening


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 24):
        b = rng.normal(size=(d, d))
        a = b @ b.T
        e, v = whitening.jacobi(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.abs(v.T @ v - np.eye(d)).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-12 * max(1, e[0])
    # Graded: the small ones have full relative accuracy, which is lost where errors are relative to the greatest.
    scale = 10.0 ** -np.arange(6)
    a = scale[:, None] * (np.eye(6) + 0.1) * scale
    e, _ = whitening.jacobi(a)
    exact = [float(x) for x in sorted(_exact(scale), reverse=True)]
    assert np.allclose(e, exact, rtol=1e-12, atol=0)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def _exact(scale):
    """Eigenvalues by bisection on the sign changes of leading minors, in many digits."""
    from decimal import Decimal as D
    from decimal import getcontext

    getcontext().prec = 80
    d = len(scale)
    s = [D(10) ** -i for i in range(d)]
    a = [[s[i] * s[j] * (D("1.1") if i == j else D("0.1")) for j in range(d)] for i in range(d)]

    def below(x):
        m, n = [[a[i][j] - (x if i == j else 0) for j in range(d)] for i in range(d)], 0
        for k in range(d):
            n += m[k][k] < 0
            for i in range(k + 1, d):
                f = m[i][k] / m[k][k]
                for j in range(k, d):
                    m[i][j] -= f * m[k][j]
        return n

    out = []
    for k in range(d):
        low, high = D(-1), D(3)
        for _ in range(150):
            mid = (low + high) / 2 + D(10) ** -70
            low, high = (low, mid) if below(mid) > k else (mid, high)
        out.append(low)
    return out


def rows(n, d, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 4
    return v.astype(np.float32).tolist()


def check(spark, vectors, components=32):
    good = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, whitened string").repartition(3)
    out = whitening.components_of(df, components=components).collect()
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    S = [sum(r[i] for r in x) for i in range(d)]
    y = np.array([[(n * c - s) / n for c, s in zip(r, S)] for r in x])
    V = y.T @ y / n
    e = np.linalg.eigvalsh(V)[::-1]
    k = min(components, d)
    got = {}
    for r in out:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(out) == n * k and sorted(got) == [i for i, _ in good]
    for (i, _), r in zip(good, x):
        assert {q["deviation"] for q in got[i].values()} == {sum((n * c - s) ** 2 for c, s in zip(r, S))}
    z = np.array([[got[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in good])
    there = e[:k] > 1e-12 * max(e.sum(), 0)
    first = next(iter(got.values()))
    for c in range(k):
        assert math.isclose(first[c + 1]["explained"], e[c] / e.sum() if there[c] else 0, rel_tol=1e-9, abs_tol=0 if there[c] else 1e-12) and first[c + 1]["n"] == n
    error = np.abs((z.T @ z / n - np.eye(k))[np.ix_(there, there)]).max(initial=0)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9 and error < 1e-9
    # Scaled back, whitened values have the covariance of what lies in their components.
    assert np.allclose(np.abs(z @ np.diag(np.sqrt(np.where(there, e[:k], 0)))).max(0)[there], np.abs(y @ np.linalg.eigh(V)[1][:, ::-1][:, :k]).max(0)[there], rtol=1e-6)


def test_equals_exact_sums(spark):
    vectors = rows(300, 12) + [None, [1.0] * 11 + [None], [float("nan")] + [0.0] * 11, [0.5] * 11 + [float("inf")]]
    check(spark, vectors)
    check(spark, vectors, components=4)


def test_fewer_vectors_than_dimensions(spark):
    check(spark, rows(5, 12))
    check(spark, [v + [0.25] for v in rows(40, 3)])


def test_nothing_and_one(spark):
    df = spark.createDataFrame([(1, None), (2, [None, 1.0])], "vec_id long, embedding array<float>")
    for x in (df, df.limit(0)):
        assert whitening.components_of(x).collect() == [] and whitening.fit(x) is None
    one = whitening.components_of(spark.createDataFrame([(None, [0.5, 0.25])] * 2, "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(None, k, 2, 0, 0.0, 0.0, 0.0) for k in (1, 2)] * 2
    assert whitening.components_of(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).collect() == []


def test_what_cannot_be_exact_is_refused(spark):
    for bad in ([[1.0, 2.0], [1.0]], [[1e30, 0.0]]):
        with pytest.raises(Exception, match="dimensions|beyond"):
            whitening.fit(spark.createDataFrame([(v,) for v in bad], "embedding array<double>").coalesce(1))
    far = spark.createDataFrame([([4e12],), ([-4e12],)], "embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened(far, whitening.fit(far)).collect()


def test_columns_stay(spark):
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(rows(30, 4))], "`a.b` long, x array<float>, deviation int")
    out = whitening.whitened(df, whitening.fit(df, "x"), "x", 2)
    assert out.columns == ["a.b", "x", "deviation", "whitened"] and out.count() == 30


def test_query(spark):
    out = registry.op13_whitening(spark, "/root/testdata/sf0.001")
    assert out.count() == 500 * 32 and out.agg({"identity_error": "max"}).first()[0] < 1e-9
