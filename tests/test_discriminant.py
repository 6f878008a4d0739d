"""Linear classifiers against plain solvers on arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import discriminant, paths
from tidewater.operators.discriminant import Problem


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (180, 3)) * [1, 30, 0.2] + [0, 500, -1]
    z = (x - x.mean(0)) / x.std(0)
    y = np.where(z[:, 0] + rng.normal(0, 1, 180) > 0.7, 1, np.where(z[:, 1] + rng.normal(0, 1, 180) > 0.8, 2, 0))
    fold = np.arange(180) % 3
    rows = [(*map(float, r), int(v), int(k)) for r, v, k in zip(x, y, fold)]
    df = spark.createDataFrame(
        rows + [(None, 1.0, 1.0, 1, 0), (float("nan"), 1.0, 1.0, 0, 1), (1.0, 1.0, 1.0, None, 2)],
        "a double, b double, c double, y int, k int"
    ).repartition(4)
    return x, y, fold, df


def plain_logistic(z, y, strength, ratio):
    """Proximal gradient to the optimum."""
    n, w = len(y), np.zeros(z.shape[1] + 1)
    zz = np.column_stack((z, np.ones(n)))
    rate = 4 * n / np.linalg.eigvalsh(zz.T @ zz)[-1]
    a = 1 / strength / n if strength else 0.0
    ahead, t = w.copy(), 1.0
    for _ in range(20000):
        g = zz.T @ (1 / (1 + np.exp(-zz @ ahead)) - y) / n
        new = ahead - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * a * ratio, 0) / (1 + rate * a * (1 - ratio))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, moved = new + (t - 1) / s * (new - w), np.abs(new - w).max()
        w, t = new, s
        if moved < 1e-13:
            break
    return w


def ap(y, s):
    out = 0.0
    for t in np.unique(s):
        hit = s >= t
        out += (y[s == t].sum() / y.sum()) * y[hit].mean()
    return out


def test_logistic_equals_plain_solver(data):
    x, y, fold, df = data
    mean, sd = x.mean(0), x.std(0)
    problems = [Problem(1, None, 0.02, 0.5), Problem(2, 1, 1.0, 1.0), Problem(0, 2, 100.0, 0.1), Problem(1, 0)]
    w = discriminant.fit_logistic(discriminant._rows(df, "abc", "y", "k"), problems, mean, sd)
    for q, got in zip(problems, w):
        keep = fold != (-1 if q.fold is None else q.fold)
        want = plain_logistic(((x - mean) / sd)[keep], (y == q.label)[keep].astype(float), q.strength, q.ratio)
        assert got == pytest.approx(want, abs=2e-5)


def test_penalty_is_chosen_by_left_out_precision(data):
    x, y, fold, df = data
    strengths, ratios = (0.003, 0.3), (0.5, 1.0)
    found = discriminant.logistic(df, list("abc"), "y", [0, 1, 2], "k", 3, strengths, ratios)
    z = (x - x.mean(0)) / x.std(0)
    for label, model in found.items():
        t = (y == label).astype(float)
        want = {}
        for c in strengths:
            for r in ratios:
                scores = []
                for k in range(3):
                    w = plain_logistic(z[fold != k], t[fold != k], c, r)
                    scores.append(ap(t[fold == k], np.round(z[fold == k] @ w[:-1] + w[-1], 12)))
                want[c, r] = np.mean(scores)
        assert model.score == pytest.approx(max(want.values()), abs=5e-3)
        assert want[model.problem.strength, model.problem.ratio] == pytest.approx(max(want.values()), abs=5e-3)
        w = plain_logistic(z, t, model.problem.strength, model.problem.ratio)
        rows = df.na.drop().where("NOT isnan(a)").select("a", "b", "c", model.probability().alias("p")).collect()
        for r in rows[:20]:
            margin = ((np.array(r[:3]) - x.mean(0)) / x.std(0)) @ w[:-1] + w[-1]
            assert r["p"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([(float(i), int(i > 5), i % 2) for i in range(12)], "a double, y int, k int")
    model = discriminant.logistic(df, ["a"], "y", [1], "k", 2, None)[1]
    assert np.isfinite(model.intercept) and model.coefficients["a"] > 0
    none = discriminant.logistic(df.where("y = 0"), ["a"], "y", [1], "k", 2)[1]
    assert np.isfinite(none.intercept)


def nipals(x, y, components):
    e, f, pred = x - x.mean(0), y - y.mean(), np.zeros(len(y))
    weights, loads, q = [], [], []
    for _ in range(components):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p = e.T @ t / (t @ t)
        q.append(t @ f / (t @ t))
        weights.append(w)
        loads.append(p)
        e, f = e - np.outer(t, p), f - t * q[-1]
    w, p = np.array(weights).T, np.array(loads).T
    return w @ np.linalg.solve(p.T @ w, np.array(q))


def test_pls_equals_nipals_out_of_fold(data):
    x, y, fold, df = data
    z = (x - x.mean(0)) / x.std(0)
    t = (y == 1).astype(float)
    binary = df.withColumn("t", (F.col("y") == 1).cast("int"))
    model, scores = discriminant.partial_least_squares(binary, list("abc"), "t", "k", 3)
    assert len(scores) == 3
    for a, got in enumerate(scores, 1):
        want = []
        for k in range(3):
            b = nipals(z[fold != k], t[fold != k], a)
            want.append(ap(t[fold == k], np.round((z[fold == k] - z[fold != k].mean(0)) @ b, 12)))
        assert got == pytest.approx(np.mean(want), abs=5e-3)
    best = model.problem.strength
    assert scores[best - 1] == max(scores)
    assert np.array(list(model.coefficients.values())) * x.std(0) == pytest.approx(nipals(z, t, best), abs=1e-8)
    assert model.intercept + np.array(list(model.coefficients.values())) @ x.mean(0) == pytest.approx(t.mean())


def test_pls_stops_where_nothing_is_left():
    gram = np.eye(3)
    b = discriminant.pls_coefficients(gram, np.array([1.0, 2.0, 0.0]), 3)
    assert b == pytest.approx(np.array([[1.0, 2.0, 0.0]] * 3))
    assert not discriminant.pls_coefficients(gram, np.zeros(3), 2).any()
    assert paths.PATH_LENGTH == 100
