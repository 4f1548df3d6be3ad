"""Whitening against exact arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from strandlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, i int, n string, whitened int, component string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "n", 3, "c") for i, v in rows], SCHEMA).repartition(3)


def exactly(vectors):
    """n, n*x - S and the covariance, without rounding before the end."""
    x = np.array([[int(np.floor(64.0 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n = len(x)
    d = n * x - x.sum(axis=0)
    return n, d, np.array([[float(Fraction(int(v), n**3)) for v in row] for row in d.T @ d])


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    return (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 3 + rng.normal(size=12) * 50).tolist()


def test_components(spark, vectors):
    nan, inf = float("nan"), float("inf")
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [None] + vectors[0][1:]), (902, [nan] + vectors[0][1:]), (903, [-inf] + vectors[0][1:]), (904, vectors[0][:5]), (905, []), (None, vectors[1]), (3, vectors[3])]
    n, d, v = exactly([*vectors, vectors[1], vectors[3]])
    values, q = np.linalg.eigh(v)
    values, q = values[::-1], q[:, ::-1]
    expected = (d.astype(float) / n) @ q / np.sqrt(values)
    wide = whitening.whitened(make(spark, rows)).collect()
    ids = [r["vec_id"] for r in wide]
    assert sorted(ids, key=lambda i: (i is None, i)) == sorted([*range(300), 3, None], key=lambda i: (i is None, i))
    order = {i: k for k, i in enumerate([*range(300), None])}
    got, want = np.array([r["whitened"] for r in wide]), expected[[order[i] for i in ids]]
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    for r in wide:
        assert r["n"] == n and r["deviation"] == sum(int(x) ** 2 for x in d[order[r["vec_id"]]]) and r["identity_error"] < 1e-12
        assert np.allclose(r["explained"], values / values.sum(), rtol=1e-12)
    long = whitening.components(make(spark, rows), 5).collect()
    assert len(long) == 5 * n and {r["component"] for r in long} == {1, 2, 3, 4, 5}
    one = {r["component"]: r["whitened"] for r in long if r["vec_id"] == 7}
    assert np.allclose([one[k] for k in range(1, 6)], got[ids.index(7)][:5], rtol=1e-9) or np.allclose(np.abs([one[k] for k in range(1, 6)]), np.abs(got[ids.index(7)][:5]), rtol=1e-9)


def test_nothing_to_whiten(spark, vectors):
    for rows in ([], [(1, None)], [(1, [])], [(1, vectors[0])], [(1, vectors[0])] * 5):
        found = whitening.components(make(spark, rows))
        assert found.count() == 0 and "identity_error" in found.columns


def test_dependent_dimensions(spark, vectors):
    rows = [(i, [*(float(round(c)) for c in v[:3]), float(round(v[0])), 7.0]) for i, v in enumerate(vectors)]
    found = whitening.whitened(make(spark, rows)).collect()
    assert {len(r["whitened"]) for r in found} == {3} and found[0]["identity_error"] < 1e-9 and abs(sum(found[0]["explained"]) - 1) < 1e-12


def exact(pair):
    return [Fraction(float(h)) + Fraction(float(low)) for h, low in zip(*map(np.atleast_1d, pair), strict=True)]


def test_double_double():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 200)) * 10.0 ** rng.integers(-8, 8, size=(2, 200))
    for f, op in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        assert exact(f(a, b)) == [op(Fraction(float(x)), Fraction(float(y))) for x, y in zip(a, b, strict=True)]
    x, y = whitening.two_sum(a, b * 1e-17), whitening.two_sum(b, a * 1e-17)
    for f, op in ((whitening.add, lambda p, q: p + q), (whitening.multiply, lambda p, q: p * q)):
        for got, p, q in zip(exact(f(x, y)), exact(x), exact(y), strict=True):
            assert abs(got - op(p, q)) <= abs(op(abs(p), abs(q))) * Fraction(1, 1 << 98)
    high, low = whitening.total((np.stack([a, -a, b * 1e-20]), np.zeros((3, 200))))
    assert all(abs(g - Fraction(float(e))) <= abs(Fraction(float(v))) / (1 << 95) for g, e, v in zip(exact((high, low)), b * 1e-20, a, strict=True))
    big = np.array([(1 << 62) + 12345, -(1 << 61) - 77, 3], dtype=np.int64)
    for got, v in zip(exact(whitening.quotient(big, 51282)), big.tolist(), strict=True):
        assert abs(got - Fraction(v, 51282)) <= abs(Fraction(v, 51282)) / (1 << 95)


def test_eigen():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    wanted = np.sort(np.concatenate([10.0 ** rng.uniform(-3, 3, size=18), [5.0, 5.0]]))[::-1]  # one value twice
    m = (q * wanted) @ q.T
    values, x = whitening.eigen(np.triu(m), np.zeros_like(m))
    assert np.allclose(values, wanted, rtol=1e-11, atol=1e-11) and np.abs(x.T @ x - np.eye(20)).max() < 1e-14 and np.abs(m @ x - x * values).max() < 1e-11
