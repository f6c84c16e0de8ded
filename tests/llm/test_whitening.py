"""Eigenpairs and whitened rows against dense solvers and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cupboard.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 60])
def test_leading_pairs_of_random_matrices(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    a = a @ a.T
    values, axes = eigen.leading(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:len(values)]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.allclose(a @ axes.T, axes.T * values, atol=1e-11 * want[0])
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-12)


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 5, 1], [1, 1 - 1e-13, 1 - 2e-13, 0.5, 0.5], [1e8, 1, 1e-3, 0, 0], [2, 2, 1e-9, 1e-9, 0], [3] * 5])
def test_equal_close_and_zero_values(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((5, 5)))
    a = q @ np.diag(np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, axes = eigen.leading(a, 5)
    assert len(values) >= 1 and np.allclose(values, spectrum[:len(values)], atol=1e-14 * max(spectrum) * 20)
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-11)
    assert np.abs(a @ axes.T - axes.T * values).max() < 1e-13 * max(spectrum) * 20


def test_diagonal_and_zero_matrices():
    values, axes = eigen.leading(np.diag([1.0, 4.0, 4.0, 2.0]), 3)
    assert np.allclose(values, [4, 4, 2]) and np.allclose(np.abs(axes[2]), [0, 0, 0, 1])
    assert len(eigen.leading(np.zeros((3, 3)), 2)[0]) == 0 and len(eigen.leading(np.zeros((0, 0)), 2)[0]) == 0


def brute(rows, k=4, scale=256):
    good = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    covariance = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        w = (np.array(x, float) - np.array(sums) / n) @ axes / np.sqrt(values)
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), w))
    return n, out, values / np.trace(covariance)


def test_rows_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.standard_normal(6) * [3, 1, 1, .5, .1, .1]]) for i in range(300)]
    hot = rows[5][1]
    rows += [(1000 + i, hot) for i in range(200)] + [(7, None), (8, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] + [0.0] * 5),
             (10, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("n", F.lit("x")).withColumn("x", F.lit(1)).repartition(5)
    got = whitening.whitened(frame).collect()
    n, want, explained = brute(rows)
    assert n == 300 and len(got) == 4 * sum(map(len, want.values()))
    of = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-10 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        of.setdefault((r.vec_id, r.component), []).append((int(r.deviation), r.whitened))
    for c in range(4):
        signs = {np.sign(of[i, c + 1][0][1] * want[i][0][1][c]) for i in range(100, 300)}
        assert len(signs) == 1
        sign = signs.pop()
        for i, w in want.items():
            mine, his = sorted(of[i, c + 1]), sorted((d, sign * v[c]) for d, v in w)
            assert [d for d, _ in mine] == [d for d, _ in his]
            assert np.allclose([v for _, v in mine], [v for _, v in his], atol=1e-9)


def test_two_runs_are_equal(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(9)], 0) for i in range(400)]
    first, second = (whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(p)) for p in (2, 7))
    assert sorted((r.vec_id, r.component, r.whitened) for r in first.collect()) == sorted((r.vec_id, r.component, r.whitened) for r in second.collect())


def test_large_entries_stay_exact(spark):
    big = 2.0 ** 40
    rows = [(1, [big, 0.0], 0), (2, [-big, 1.0], 0), (3, [0.0, big], 0)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = {1: (256 * 2 ** 40, 0), 2: (-256 * 2 ** 40, 256), 3: (0, 256 * 2 ** 40)}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    assert got == {i: sum((3 * v[k] - sums[k]) ** 2 for k in (0, 1)) for i, v in x.items()}


def test_few_rows_other_lengths_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [3.0], 0), (4, [], 0), (5, [4.0, 2.0], None)], SCHEMA)
    got = whitening.whitened(frame).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1), (5, 1)} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
    for where in ("vec_id < 3", "embedding is null", "false"):
        none = whitening.whitened(frame.where(where))
        assert none.count() == 0 and none.columns[0] == "vec_id"
