"""Whitening against numpy's dense eigenvectors, and its defined cases."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from folio.llm import whitening as W
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, x array<long>, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, [9], 3) for i, v in rows], SCHEMA)


def brute(rows, k=4):
    """id -> (deviation, whitened by component), with n, explained; signs as numpy has them."""
    ok = [(i, [math.floor(np.float32(c).item() * 256) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (d - len(v))) for i, v in ok]
    fit = np.array(sorted({tuple(v) for _, v in ok}), dtype=np.float64).reshape(-1, d)
    n, sums = len(fit), fit.sum(axis=0).astype(int).tolist()
    c = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    values, vectors = values[order], vectors[:, order]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), (np.array(v) - fit.mean(axis=0)) @ vectors / np.sqrt(np.maximum(values, 1e-300))) for i, v in ok]
    return n, values / (c**2).sum() * n, out


def held(spark, rows, k=4):
    n, explained, expected = brute(rows, k)
    got = {}
    for r in W.whiten(table(spark, rows), components=k).collect():
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    kept = sum(e > 1e-12 for e in explained)
    assert sum(map(len, got.values())) == kept * len(expected)
    flips = {}
    for i, deviation, values in expected:
        for component, value in got[i, deviation]:
            want = values[component - 1]
            if abs(want) > 1e-6:
                flips.setdefault(component, set()).add(round(value / want, 6))
            assert abs(value) == pytest.approx(abs(want), abs=1e-7)
    assert all(f in ({1.0}, {-1.0}) for f in flips.values())


def test_table_is_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    held(spark, list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [4, 2, 1, 0.5, 0.2, 0.1]).tolist()) for i in range(300)]
    rows += [(900 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (5, rows[5][1])]  # a hot vector, a null id, a repeated row
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1005, [1.5, -0.0]), (1006, [-0.001] * 6)]
    held(spark, rows)


def test_small_tables(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    two = W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    held(spark, [(i, [float(i % 3), float(i % 5), float(i // 7)]) for i in range(60)])
    held(spark, [(i, [float(i)]) for i in range(5)])


@pytest.mark.parametrize("guards", [0, 4, 12])
def test_residuals_are_certified(guards):
    """Products are those of a matrix with close eigenvalues; the pairs are the leading ones, to double precision."""
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    e = np.linspace(1, 2, 80)
    v = (q * e) @ q.T
    values, vectors, residual, passes = W.lobpcg(lambda b: v @ b, 80, 4, guards, 1e-13, 500)
    assert residual <= 1e-13 and passes < 200
    assert values == pytest.approx(e[::-1][:4], rel=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12


def test_passes_that_run_out_are_an_error(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(40).tolist()) for i in range(200)]
    with pytest.raises(ArithmeticError, match="certified"):
        W.whiten(table(spark, rows), guards=0, most=3).collect()


def test_deviations_are_exact_or_stop():
    x = np.array([[1 << 20, -5], [3, 7]])
    n, sums = 3_000_001, [1_234_567_890, -3]
    assert W.deviations(x[1:], n, sums).tolist() == [(n * 3 - sums[0]) ** 2 + (n * 7 - sums[1]) ** 2]
    with pytest.raises(OverflowError):
        W.deviations(x, n, sums)
