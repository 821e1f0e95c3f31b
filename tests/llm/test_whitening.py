import math
import random
from fractions import Fraction

import numpy as np
import pytest

from retailcast.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def vectors(seed, n, d, spread=None):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    x = rng.normal(size=(n, d)) * (spread if spread is not None else 1.0)
    return (x @ mix).astype(np.float32)


@pytest.mark.parametrize("n,d,k", [(300, 12, 8), (40, 5, 8), (20, 3, 2)])
def test_equals_eigenvectors(spark, n, d, k):
    data = vectors(n, n, d)
    got = w.whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(data)]).repartition(3), k=k).collect()
    x = np.floor(1024 * data.astype(float)) + 100000
    cov = (x - x.mean(0)).T @ (x - x.mean(0)) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * min(k, d)
    want = (x - x.mean(0)) @ u / np.sqrt(e)
    white = np.zeros((n, min(k, d)))
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        white[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(0)))
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-10)
        assert r["identity_error"] < 1e-9
    for c in range(min(k, d)):
        sign = 1 if white[:, c] @ want[:, c] > 0 else -1
        assert np.allclose(sign * white[:, c], want[:, c], atol=1e-8)


def test_rows_without_a_usable_vector(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, v.tolist()) for i, v in enumerate(vectors(2, 30, 3))] + [(5, [1.0, 2.0, 3.0])] * 2
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [1.0, -inf, 0.0]),
           (105, [1.0, 2.0]), (106, [1.0, 2.0, 3.0, 4.0])]
    got = w.whiten(table(spark, good + odd)).collect()
    assert len(got) == 32 * 3 and {r["n"] for r in got} == {32}
    assert {r["vec_id"] for r in got} == set(range(30))
    assert w.whiten(table(spark, odd[:5])).collect() == []
    assert w.whiten(table(spark, [])).collect() == []


def test_vectors_without_variance(spark):
    flat = [(i, [0.5, float(i % 2), 0.25]) for i in range(6)]   # one component has variance
    got = w.whiten(table(spark, flat)).collect()
    assert all(r["whitened"] == 0 and r["explained"] == 0 for r in got if r["component"] > 1)
    assert {abs(r["whitened"]) for r in got if r["component"] == 1} == {1.0}
    assert all(r["identity_error"] < 1e-12 for r in got)
    alone = w.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in alone] == [(0, 0.0, 0.0)] * 2


def test_equal_roots_get_orthogonal_components(spark):
    cross = [[s if j == i else 0.0 for j in range(4)] for i in range(4) for s in (1.0, -1.0)]
    m = w.moments(table(spark, list(enumerate(cross))), "embedding", 4, 1024.0)
    parts = w.components(spark, m, 4)
    assert np.allclose(parts.vectors @ parts.vectors.T, np.eye(4), atol=1e-15)
    assert len(set(parts.eigenvalues)) == 1
    got = w.whiten(table(spark, list(enumerate(cross)))).first()
    assert got["identity_error"] < 1e-12


def test_large_entries_stay_exact(spark):
    data = [(i, [1e30 * (-1) ** i, float(i), 1e12 * i]) for i in range(5)]
    m = w.moments(spark.createDataFrame(data, SCHEMA), "embedding", 3, 1024.0)
    x = [[min(max(math.floor(1024 * float(np.float32(c))), -2**62), 2**62) for c in v] for _, v in data]
    assert m.sums == [sum(v[j] for v in x) for j in range(3)]
    assert m.products.tolist() == [[sum(v[i] * v[j] for v in x) for j in range(3)] for i in range(3)]
    got = w.whiten(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in got) and got[0]["identity_error"] < 1e-4


def test_exact_products():
    rng = np.random.default_rng(0)
    for top in (3, 1 << 19, 1 << 20, 1 << 40, 1 << 61):
        x = rng.integers(-top, top, (70, 4))
        assert (w.exact_products(x) == x.astype(object).T.dot(x.astype(object))).all()


def determinant(m):
    m, d = [[Fraction(x) for x in row] for row in m], len(m)
    out = Fraction(1)
    for c in range(d):
        p = next((r for r in range(c, d) if m[r][c]), None)
        if p is None:
            return Fraction(0)
        if p != c:
            m[c], m[p], out = m[p], m[c], -out
        out *= m[c][c]
        for r in range(c + 1, d):
            f = m[r][c] / m[c][c]
            m[r] = [a - f * b for a, b in zip(m[r], m[c])]
    return out


@pytest.mark.parametrize("seed,d,rank", [(0, 6, 6), (1, 5, 2), (2, 1, 1), (3, 4, 0), (4, 7, 7)])
def test_polynomial_is_exact(spark, seed, d, rank):
    rng = random.Random(seed)
    half = [[rng.randint(-10**6, 10**6) for _ in range(d)] for _ in range(rank)]
    m = [[sum(h[i] * h[j] for h in half) for j in range(d)] for i in range(d)]
    if seed == 4:   # zeros that need another pivot
        m = [[x if (i + j) % 3 == 0 else 0 for j, x in enumerate(row)] for i, row in enumerate(m)]
        m = [[sum(a * b for a, b in zip(r, s)) for s in m] for r in m]
    poly = w.characteristic_polynomial(spark, m)
    for t in (-3, 0, 1, 10**7, 12345678901):
        value = determinant([[t * (i == j) - x for j, x in enumerate(row)] for i, row in enumerate(m)])
        assert sum(c * t**k for k, c in enumerate(poly)) == value


def test_roots_are_isolated():
    roots = [0, 0, 3, 3, 10**9, 10**9 + 1, 10**15, 10**15, 7]
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    found = [Fraction(at, 2**bits) for at, bits in w.largest_roots(poly, 9, sum(roots) + 1)]
    for got, want in zip(found, sorted(roots, reverse=True)):
        assert abs(got - want) <= Fraction(want or 0, 10**w.DIGITS) * 10
    assert found[0] == found[1] and found[4] != found[5]


def test_limbs():
    for v in (0, 1, -1, 2**200 + 12345, -(2**100) + 7):
        assert sum(x << w.LIMB_BITS * k for k, x in enumerate(w.limbs(v))) == v
