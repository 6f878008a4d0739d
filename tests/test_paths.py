"""Elastic-net paths against plain coordinate descent and refits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import paths


def plain(x, y, alpha, ratio, sd=None):
    """Coordinate descent on the rows: intercept and coefficients of the unscaled columns."""
    mean, sd = x.mean(0), x.std(0) if sd is None else sd
    z, t, n = (x - mean) / sd, y - y.mean(), len(y)
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        before = w.copy()
        for j in range(len(w)):
            rest = z[:, j] @ (t - z @ w + z[:, j] * w[j]) / n
            w[j] = np.sign(rest) * max(abs(rest) - alpha * ratio, 0) / (z[:, j] @ z[:, j] / n + alpha * (1 - ratio))
        if np.abs(w - before).max() < 1e-13:
            break
    b = w / sd
    return y.mean() - b @ mean, b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (90, 4)) * [1, 20, 0.1, 5] + [0, 1e6, 3, -50]
    return x, x @ [1.0, 0.3, 0.0, -0.2] + rng.normal(0, 1, 90), np.arange(90) % 4


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, fold = data
    rows = [(*map(float, r), float(v), int(k)) for r, v, k in zip(x, y, fold)]
    more = [(None, 1.0, 1.0, 1.0, 1.0, 0), (1.0, 1.0, 1.0, float("nan"), 1.0, 0), (1.0, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows + more, "a double, b double, c double, d double, y double, k int").repartition(5)


@pytest.mark.parametrize("in_folds", [True, False])
def test_grid_equals_refits_on_rows(data, frame, in_folds):
    x, y, fold = data
    m = paths.moments(frame, list("abcd"), "y", "k", 4)
    fit, table = paths.search(m, (0.01, 0.3, 2.0), (0.2, 1.0), in_folds)
    assert len(table) == 6
    for alpha, ratio, mse in table:
        errors = []
        for k in range(4):
            c, b = plain(x[fold != k], y[fold != k], alpha, ratio, None if in_folds else x.std(0))
            errors.append(((y - c - x @ b)[fold == k] ** 2).mean())
        assert mse == pytest.approx(np.mean(errors), rel=1e-6)
    best = min(table, key=lambda r: r[2])
    assert (fit.alpha, fit.ratio, fit.mse) == best
    c, b = plain(x, y, fit.alpha, fit.ratio)
    assert list(fit.coefficients.values()) == pytest.approx(b, abs=1e-7) and fit.intercept == pytest.approx(c, rel=1e-6)
    got = fit.predict(frame.where("k IS NOT NULL").na.drop().where("NOT isnan(d)"), "g").select("g", "a").orderBy("a").collect()
    assert [r["g"] for r in got] == pytest.approx((c + x @ b)[np.argsort(x[:, 0])], abs=1e-5)


def test_paths_start_where_no_coefficient_is_left(frame):
    m = paths.moments(frame, list("abcd"), "y", "k", 4)
    fit, table = paths.search(m, None, paths.PATH_RATIOS)
    assert len(table) == 500
    gram, target, _ = paths._scaled(m, None)
    top = max(a for a, ratio, _ in table if ratio == 0.5)
    assert not paths.descend(gram[None], target[None], np.array([[top * 1.0001]]), np.array([0.5])).any()
    assert paths.descend(gram[None], target[None], np.array([[top * 0.999]]), np.array([0.5])).any()
    assert fit.mse == min(e for *_, e in table)


def test_sums_are_one_scan_and_do_not_depend_on_parts(frame):
    a, b = (paths.moments(f, list("abcd"), "y", "k", 4) for f in (frame, frame.coalesce(1)))
    for k in (None, 0, 3):
        for u, v in zip(a.without(k), b.without(k)):
            assert u == pytest.approx(v, rel=1e-9, abs=1e-9)
    assert a.n.tolist() == [23, 23, 22, 22]


def test_constant_columns_and_no_rows(frame):
    m = paths.moments(frame.withColumn("e", F.lit(7.0)), list("abcde"), "y", "k", 4)
    fit, _ = paths.search(m)
    assert fit.coefficients["e"] == 0.0 and fit.coefficients["a"] != 0.0
    fit, table = paths.search(paths.moments(frame.where("false"), list("abcd"), "y", "k", 4))
    assert len(table) == 36 and not any(fit.coefficients.values())


@pytest.mark.parametrize("reverse", [False, True])
def test_fold_predictions_equal_refits(data, frame, reverse):
    x, y, fold = data
    known = frame.where("k IS NOT NULL").na.drop().where("NOT isnan(d)")
    got = {(r["run"], r["a"]): r["predicted"] for r in paths.fold_predictions(known, "a", list("abcd"), "y", "k", 4, reverse).collect()}
    assert len(got) == len(y) * (3 if reverse else 1)
    for k in range(4):
        learn = fold == k if reverse else fold != k
        c, b = plain(x[learn], y[learn], 0.0, 1.0)
        for i in np.flatnonzero(~learn):
            assert got[k, x[i, 0]] == pytest.approx(c + x[i] @ b, abs=1e-5)
