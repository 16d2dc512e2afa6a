"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from breezeline.llm import whitening

KINDS = "vec_id long, embedding array<float>, x long, n string, dim int, component int"


def table(spark, data):
    return spark.createDataFrame([(i, v, 1, "n", 2, 3) for i, v in data], KINDS).repartition(3)


def vectors(seed=2, dims=7):
    dice = np.random.default_rng(seed)
    mixed = dice.normal(size=(90, dims)) @ dice.normal(size=(dims, dims))
    out = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(mixed)]
    out += [(200 + i, out[3][1]) for i in range(40)]  # copies count once
    out += [(300, [x + 1e-4 for x in out[4][1]]), (301, [-0.0] * dims), (5, out[5][1]), (5, out[6][1])]
    out += [(400, None), (401, [1.0] * (dims - 1) + [None]), (402, [float("nan")] * dims), (403, [float("-inf")] + [0.0] * (dims - 1))]
    return out + [(None, out[7][1]), (None, out[8][1]), (404, []), (405, [0.5, 1.5])]


def whole(v, dims):
    return [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dims - len(v))


def check(got, data, dims, most):
    usable = [(i, whole(v, dims)) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, units = np.linalg.eigh(centred.T @ centred / n)
    values, units = values[::-1], units[:, ::-1]
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation_digits), []).append(r)
    assert len(got) == most * len(usable)
    signs = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        each = rows[i, str(deviation)]
        assert {r.component for r in each} == set(range(1, most + 1))
        for r in each:
            k = r.component - 1
            want = np.dot([(n * a - s) / n for a, s in zip(x, sums)], units[:, k]) / np.sqrt(values[k])
            sign = signs.setdefault(k, 1 if abs(r.whitened - want) < 1e-6 else -1)
            assert r.whitened * sign == pytest.approx(want, abs=1e-8)
            assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("seed, dims", [(2, 7), (3, 16)])
def test_whitening(spark, seed, dims):
    data = vectors(seed, dims)
    check(whitening.whiten(table(spark, data)).collect(), data, dims, 4)


def test_few_dimensions_and_great_components(spark):
    dice = np.random.default_rng(4)
    data = [(i, [float(a), float(np.float32(b * 1e15))]) for i, (a, b) in enumerate(dice.normal(size=(50, 2)))]
    got = whitening.whiten(table(spark, data)).collect()
    check(got, data, 2, len({r.component for r in got}))
    assert all(r.deviation is None for r in got if int(r.deviation_digits) >= 2**63)


def test_rank_bounds_the_components(spark):
    line = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(20)]
    got = whitening.whiten(table(spark, line)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_nothing_to_fit(spark):
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_too_great_a_component_is_told(spark):
    with pytest.raises(Exception, match="does not fit 64 bits"):
        whitening.whiten(table(spark, [(1, [3e30, 1.0]), (2, [1.0, 2.0])])).collect()


def test_factors():
    dice = np.random.default_rng(5)
    for size, rank in ((1, 1), (6, 6), (9, 4), (30, 30)):
        a = dice.normal(size=(size, rank)) * 10.0 ** dice.integers(-3, 4, rank)
        factor = whitening.pivoted_cholesky(a @ a.T)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a @ a.T, rtol=1e-9)
        values, units = whitening.jacobi_columns(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a @ a.T)[::-1][:rank], rtol=1e-8)
        assert np.allclose(units.T @ units, np.eye(rank), atol=1e-10)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
