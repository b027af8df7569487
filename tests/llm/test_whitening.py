"""Whitening against numpy's eigenvalues and whole numbers of Python."""

import math

import numpy as np
import pytest

from scenelake.llm import whitening
from scenelake.llm.whitening import leading_pairs, values_above

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def checked(vectors, rows, k=32):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[n * r[i] - s[i] for i in range(d)] for r in x], object)
    v = np.array(centred.T @ centred / n**3, float)
    e = np.linalg.eigvalsh(v)[::-1]
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    found = len(next(iter(by_id.values())))
    white = np.array([[by_id[i][c].whitened for c in range(1, found + 1)] for i in sorted(by_id)])
    assert [by_id[i][1].deviation for i in sorted(by_id)] == [int(sum(c * c for c in row)) for row in centred]
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    one = next(iter(by_id.values()))
    assert np.allclose([one[c].explained for c in range(1, found + 1)], e[:found] / v.trace(), rtol=1e-9)
    error = np.abs(white.T @ white / n - np.outer(white.mean(0), white.mean(0)) - np.eye(found)).max()
    assert rows[0].identity_error < 1e-8 and error < 1e-8
    # the projections span the same space: squared lengths over whole clusters agree with numpy's
    w, u = np.linalg.eigh(v)
    own = np.array(centred / n, float) @ u[:, ::-1][:, :found] / np.sqrt(w[::-1][:found])
    gaps = [i for i in range(1, found) if w[::-1][i - 1] - w[::-1][i] > 1e-6 * w[-1]]
    for a, b in zip([0, *gaps], [*gaps, found]):
        if b < found or found == d or w[::-1][found - 1] - w[::-1][found] > 1e-6 * w[-1]:
            assert np.allclose((white[:, a:b] ** 2).sum(1), (own[:, a:b] ** 2).sum(1), atol=1e-6)
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 6, 64, 120])
def test_eigenpairs(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    a = a @ a.T
    k = min(32, n)
    values, vectors = leading_pairs(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0]


@pytest.mark.parametrize("a", [np.eye(40) * 3, np.diag([5.0] * 20 + [1.0] * 20), np.kron(np.eye(10), [[2.0, 1], [1, 2]]), np.ones((50, 50)), np.diag(10.0 ** -np.arange(12))])
def test_clusters(a):
    k = min(32, len(a))
    values, vectors = leading_pairs(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_sturm_counts():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[10] = 0.0
    real = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.standard_normal(50)
    assert (values_above(d, e, at) == (real[None, :] > at[:, None]).sum(1)).all()


def test_whiten(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((150, 40)) * np.linspace(2, 0.1, 40)).tolist()
    good[1] = good[0]
    rows = [(i, v, None, 7, "c") for i, v in enumerate(good)]
    bad = [(900, None, 1, 7, "c"), (901, [None] * 40, 1, 7, "c"), (902, [float("nan")] * 40, 1, 7, "c"), (903, [1.0] * 39 + [float("inf")], 1, 7, "c"), (904, [1.0] * 7, 1, 7, "c"), (905, [], 1, 7, "c")]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(7)
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == set(range(150)) and checked(good, got) == 32
    # the model is the same bit by bit however the rows are dealt
    again = {(r.vec_id, r.component): r for r in whitening.whiten(df.repartition(2)).collect()}
    assert all(again[r.vec_id, r.component].explained == r.explained and abs(again[r.vec_id, r.component].whitened - r.whitened) < 1e-12 for r in got)


def test_few_directions_and_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 1.5], 0, 0, "") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    flat = [[float(i), 2.0 * i, 1.0] for i in range(20)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(flat)], SCHEMA)).collect()
    assert checked(flat, got) == 1
    # null and repeated ids are rows of their own; far entries stay whole
    rows = [(None, [1.0, 2.0], 0, 0, ""), (3, [4.0, 1.0], 0, 0, ""), (3, [4.0, 1.0], 0, 0, ""), (None, [0.0, 7.0], 0, 0, "")]
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 8
    far = [[3e8, 1.0], [-3e8, 2.0], [1.0, 5.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(far)], SCHEMA)).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in far]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((3 * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 1 << 63 else None for i, v in enumerate(exact)}
