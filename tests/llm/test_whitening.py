"""Whitening against numpy on odd rows, the bidiagonal solver on hard spectra."""

import math

import numpy as np
import pytest

from textguard.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, x long, component string, node long, n double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "c", 3, 0.5) for i, v in rows], SCHEMA)


def brute(rows, components=16):
    """{row number: (n, deviation, whitened, explained)} with signs as numpy gives them."""
    kept = [(k, v) for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in kept}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k, v in x.items():
        gap = [n * c - s for c, s in zip(v, sums)]
        out[k] = (n, sum(g * g for g in gap), (np.array(gap, float) / n) @ vectors[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum())
    return out


def check(got, rows, want, components):
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert sorted(by_id) == sorted(rows[k][0] for k in want)
    signs = None
    for k, (n, deviation, y, share) in want.items():
        own = sorted(by_id[rows[k][0]], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, components + 1))
        assert {r.n for r in own} == {n} and {r.deviation for r in own} == {deviation}
        mine = np.array([r.whitened for r in own])
        signs = np.sign(mine * y) if signs is None else signs
        assert np.allclose(mine * signs, y, atol=1e-9)
        assert np.allclose([r.explained for r in own], share, rtol=1e-9) and all(r.identity_error < 1e-9 for r in own)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=20) * np.linspace(3, 0.2, 20)).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(150)]  # a third is one vector
    rows += [(2000, None), (2001, []), (2002, [1.0] * 19 + [float("nan")]), (2003, [1.0] * 19 + [float("inf")]), (2004, [None] + [1.0] * 19)]
    want = brute(rows)
    got = w.query(frame(spark, rows).repartition(7)).collect()
    check(got, rows, want, 16)
    assert len(got) == 16 * 450


def test_many_triangles_are_stacked(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(400)]
    check(w.whiten(frame(spark, rows).repartition(40), 3).collect(), rows, brute(rows, 3), 3)


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    check(w.query(table).collect(), rows, brute(rows), 16)


def test_lengths_ids_and_degenerate_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 1.0]), (None, [0.0, 5.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    got = w.query(frame(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == [("1", 1), ("1", 1), ("1", 2), ("1", 2), ("None", 1), ("None", 2)]
    assert w.query(frame(spark, [])).count() == 0 and w.query(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    # The second dimension never varies and the third repeats the first: one direction has variance.
    flat = w.query(frame(spark, [(k, [float(k), 1.0, float(k)]) for k in range(5)])).collect()
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)


def rotation(rng, rows, columns):
    return np.linalg.qr(rng.normal(size=(rows, columns)))[0]


@pytest.mark.parametrize("seed", range(12))
def test_solver_on_clustered_values(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    values = rng.choice([1, 2, 2 + 1e-13, 2 + 1e-10, 2 + 1e-7, 2 + 1e-5, 1e-5, 0.5, 0], size=d)
    m = rotation(rng, 60, d) * values @ rotation(rng, d, d).T
    a, b, v = w.bidiagonalise(np.linalg.qr(m, mode="r"))
    squares, z = w.right_vectors(a, b)
    v = v @ z
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 * max(d, 8)
    assert np.abs(m.T @ (m @ v) - v * squares).max() <= 1e-13 * d * max(1e-9, values.max()) ** 2


def test_small_singular_values_keep_their_digits():
    """Of a graded bidiagonal matrix, dqds finds even the smallest values to nearly full relative precision."""
    a = 10.0 ** -np.arange(12)
    b = 0.3 * a[:-1]
    got = np.sqrt(w.squared_singular_values(a, b))
    # The product of singular values is that of the diagonal; the ratio to the diagonal stays moderate.
    assert abs(np.prod(got / a) - 1) < 1e-13
    exact = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)
    assert np.allclose(got[:4], exact[:4], rtol=1e-13)
    assert (w.squared_singular_values(np.zeros(3), np.zeros(2)) == 0).all()
