"""Boosted trees against exact splits in NumPy, and their sampling, folds, unknown values and leaves."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.functions.trees import attributions, expected
from tidewater.operators import boosting
from tidewater.operators.boosting import Setting


def exact_tree(x, g, h, depth, penalty=1.0, least=1.0):
    """Nested (feature, threshold, left, right), or (gradient sum, Hessian sum) in leaves."""
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    best, all_ = (0.0, None), np.ones(len(g), bool)
    for j in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) >= least and (gain := score(left) + score(~left) - score(all_)) > best[0] + 1e-9:
                best = gain, (j, cut, left)
    if best[1] is None:
        return g.sum(), h.sum()
    j, cut, left = best[1]
    return j, cut, *(exact_tree(x[m], g[m], h[m], depth - 1, penalty, least) for m in (left, ~left))


def exact_boost(x, y, depth, rate, rounds, logistic=False):
    base = y.mean()
    f = np.full(len(y), np.log(base / (1 - base)) if logistic else base)

    def value(tree, row):
        while len(tree) == 4:
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return -rate * tree[0] / (tree[1] + 1.0)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = exact_tree(x, p - y, p * (1 - p), depth) if logistic else exact_tree(x, f - y, np.ones(len(y)), depth)
        f = f + np.array([value(tree, row) for row in x])
    return 1 / (1 + np.exp(-f)) if logistic else f


def frame(spark, x, y, **more):
    rows = [(i, *map(float, r), float(v), *(int(c[i]) for c in more.values())) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(
        rows, ", ".join(["id long", *[f"x{j} double" for j in range(x.shape[1])], "y double", *[f"{c} int" for c in more]])
    ).repartition(3)


def guesses(df, model, run, rounds):
    return np.array([r["g"] for r in boosting.predict(df, model, {"g": (run, rounds)}).orderBy("id").select("g").collect()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (150, 3)).astype(float)
    return x, x[:, 0] * 2 + (x[:, 1] > 9) * x[:, 2] + rng.normal(0, 1, 150)


def test_edges_are_exact_beyond_any_summary(spark):
    """An approximate summary of 10,000 values is off by some of 60,000 rows."""
    x = np.random.default_rng(8).permutation(60_001).astype(float)
    df = spark.createDataFrame([(float(v), float(v % 3)) for v in x] + [(None, float("nan"))], "a double, b double").repartition(7)
    a, b = boosting.quantile_edges(df, ["a", "b"], 64)
    assert a.tolist() == [float(-(-i * 60_001 // 64) - 1) for i in range(1, 64)] and b.tolist() == [0.0, 1.0, 2.0]
    assert [e.tolist() for e in boosting.quantile_edges(df.where("false"), ["a", "b"], 8)] == [[], []]


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_equal_to_exact_splits(spark, data, loss):
    x, y = data
    y = (y > np.median(y)).astype(float) if loss == "logistic" else y
    df = frame(spark, x, y)
    model, _ = boosting.boost(df, "id", ["x0", "x1", "x2"], "y", [Setting(3, 0.3), Setting(1, 1.0)], 12, loss=loss, bins=250)
    for run, (depth, rate, rounds) in enumerate(((3, 0.3, 12), (1, 1.0, 5))):
        assert guesses(df, model, run, rounds) == pytest.approx(exact_boost(x, y, depth, rate, rounds, loss == "logistic"), abs=1e-6)


def test_folds_equal_fits_without_them(spark, data):
    x, y = data
    fold = np.arange(len(y)) % 3
    df = frame(spark, x, y, part=fold)
    model, scores = boosting.boost(df, "id", ["x0", "x1", "x2"], "y", [Setting(2, 0.2)], 6, folds=3, fold="part", bins=200, score_at=(3, 6))
    got = {(model.folds[r["run"]], r["rounds"]): r for r in scores.collect()}
    for k in range(3):
        out = fold == k
        alone, _ = boosting.boost(df.where(F.col("part") != k), "id", ["x0", "x1", "x2"], "y", [Setting(2, 0.2)], 6, bins=200)
        assert len(alone.rounds) == 6
        for n in (3, 6):
            error = ((guesses(df, model, model.folds.index(k), n) - y)[out] ** 2).sum()
            assert got[k, n]["n"] == out.sum() and got[k, n]["error"] == pytest.approx(error)
    best = boosting.chosen(model, scores)
    assert len(best) == 2 and best[0]["mse"] <= best[1]["mse"] and model.folds[best[0]["run"]] is None


def test_unknown_values_go_where_they_gain(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (200, 2)).astype(float)
    y = np.where(x[:, 0] > 4, 10.0, 0.0) + rng.normal(0, 0.1, 200)
    x[(rng.random(200) < 0.4) & (y > 5), 0] = np.nan
    df = frame(spark, x, y).withColumn("x0", F.when(F.isnan("x0"), None).otherwise(F.col("x0")))
    model, _ = boosting.boost(df, "id", ["x0", "x1"], "y", [Setting(1, 1.0)], 1, penalty=0.0)
    assert model.rounds[0].feature[0, 0] == 0 and not model.rounds[0].unknown_left[0, 0]
    assert np.abs(guesses(df, model, 0, 1) - y).max() < 1.0


def test_rows_and_columns_are_drawn(spark, data):
    x, y = data
    df = frame(spark, x, y)
    settings = [Setting(2, 0.3, 0.5, 0.34), Setting(2, 0.3, 1.0, 1.0), Setting(2, 0.3, 0.5, 0.34)]
    model, _ = boosting.boost(df, "id", ["x0", "x1", "x2"], "y", settings, 9, seed=5)
    again, _ = boosting.boost(df.repartition(5), "id", ["x0", "x1", "x2"], "y", settings, 9, seed=5)
    used = [set(t.feature[0][t.feature[0] >= 0].tolist()) for t in model.rounds]
    assert all(len(u) <= 1 for u in used) and len(set.union(*used)) == 3
    assert 40 < model.rounds[0].cover[0, 0] < 110 and model.rounds[0].cover[1, 0] == 150
    for a, b in zip(model.rounds, again.rounds):
        assert (a.feature == b.feature).all() and a.value == pytest.approx(b.value)
        assert (a.value[0] == a.value[2]).all()


def test_passes_of_few_runs_and_stored_margins_change_nothing(spark, data, monkeypatch):
    x, y = data
    df = frame(spark, x, y)
    settings = [Setting(3, 0.3), Setting(2, 0.1), Setting(1, 0.5)]
    want, _ = boosting.boost(df, "id", ["x0", "x1", "x2"], "y", settings, 5)
    monkeypatch.setattr(boosting, "CELLS", 1)
    monkeypatch.setattr(boosting, "RENEWED", 2)
    got, _ = boosting.boost(df, "id", ["x0", "x1", "x2"], "y", settings, 5)
    for a, b in zip(want.rounds, got.rounds):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and a.value == pytest.approx(b.value)


def test_leaves_and_importances(spark, data):
    x, y = data
    df = frame(spark, x, y)
    model, _ = boosting.boost(df, "id", ["x0", "x1", "x2"], "y", [Setting(3, 0.3)], 4)
    leaves = model.leaves(0, 4)
    assert attributions(leaves, x).sum(1) + expected(leaves) + model.base[0] == pytest.approx(guesses(df, model, 0, 4))
    shares = model.importances(0, 4)
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "x0"


def test_published_grids():
    for options in (boosting.GRID, boosting.ATTRIBUTION_GRID):
        settings, rounds = boosting.grid(options)
        assert len(settings) * len(rounds) == 108
    settings, rounds = boosting.grid(boosting.SMALL_GRID)
    assert len(settings) * len(rounds) == 12


def test_few_rows_and_constant_columns(spark):
    df = frame(spark, np.array([[1.0, 5.0], [1.0, 5.0]]), np.array([1.0, 3.0]))
    model, _ = boosting.boost(df, "id", ["x0", "x1"], "y", [Setting(2, 1.0)], 2)
    assert guesses(df, model, 0, 2) == pytest.approx([2.0, 2.0])
    assert boosting.boost(df.where("id < 0"), "id", ["x0", "x1"], "y", [Setting(2, 1.0)], 1)[0].base.tolist() == [0.0]
    with pytest.raises(ValueError, match="bins"):
        boosting.boost(df, "id", ["x0"], "y", [Setting()], 1, bins=255)


def test_left_out_precision_of_a_logistic_loss(spark, data):
    x, y = data
    y, fold = (y > np.median(y)).astype(float), np.arange(len(y)) % 3
    df = frame(spark, x, y, part=fold)
    model, scores = boosting.boost(
        df, "id", ["x0", "x1", "x2"], "y", [Setting(2, 0.3), Setting(1, 0.1)], 4, folds=3, fold="part", loss="logistic",
        score_at=(2, 4)
    )
    for r in scores.collect():
        out = fold == model.folds[r["run"]]
        p = np.round(guesses(df, model, r["run"], r["rounds"]), 4)[out]
        want = sum(y[out][p == t].sum() / y[out].sum() * y[out][p >= t].mean() for t in np.unique(p))
        assert r["precision"] == pytest.approx(want, abs=0.02)
    best = boosting.chosen(model, scores, "precision")
    assert best[0]["precision"] >= best[-1]["precision"] and len(best) == 4


def test_margins_are_read_in_place_and_by_slices():
    """A batch of any length is taken in parts of STEP rows, whose numbers are not copied."""
    n, rng = 2 * boosting.STEP + 5, np.random.default_rng(3)
    codes, f = rng.integers(0, 255, (n, 3)).astype(np.uint8), rng.normal(size=(n, 7))
    plain = [pa.array(np.arange(n)), pa.array(np.arange(n) / 2), pa.array(np.zeros(n, np.int32))]
    batch = pa.RecordBatch.from_arrays([*plain, boosting._binary(codes), boosting._binary(f)], ["id", "y", "fold", "codes", "f"])
    assert batch.column("f").to_pylist() == [x.tobytes() for x in f]
    parts = [boosting._rows(b, 7, 3) for b in boosting._slices([batch])]
    assert [len(p[0]) for p in parts] == [boosting.STEP, boosting.STEP, 5]
    assert all((np.concatenate([p[i] for p in parts]) == want).all() for i, want in ((0, np.arange(n)), (3, codes), (4, f)))
    assert not any(p[4].flags.owndata for p in parts)
