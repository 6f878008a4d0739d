"""Preparation, statistics, selection, models, clusterings, sources and streams on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import tails
from tidewater.functions.trees import Leaf, attributions, expected
from tidewater.functions import arrays
from tidewater.operators import cluster, models, pairs, prep, selection, spectral, statistics
from tidewater.sources import io
from tidewater.streaming import ranges


def test_quality_gate_modes(spark):
    df = spark.createDataFrame([(1, None), (2, 69.9), (3, 70.0)], "id int, qc double")
    assert [r["id"] for r in prep.quality_gate(df, "qc").orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in prep.quality_gate(df, "qc", keep_unknown=False).collect()] == [3]


def test_one_hot_ties_and_none_set(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 1)], "id int, race_a int, race_b int")
    assert [r["race"] for r in prep.collapse_one_hot(df, "race_", "race").orderBy("id").collect()] == ["a", "a", "b"]


def test_imputation_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", float("nan")), (None, 5.0)], "g string, x double")
    assert sorted(
        (r["g"] or "", r["x"] or -1) for r in prep.impute_by_group(df, "g", ["x"]).collect()
    ) == [("", 5.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", -1)]


def test_assignments_must_be_whole(spark):
    base, some = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 0)], "id int, cluster int")
    with pytest.raises(prep.IntegrityError):
        prep.join_assignments(base, some, "id")


def test_u_statistic_and_tails(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 2.0, 3.0)] + [("y", v) for v in (2.0, 4.0, 5.0)], "g string, v double")
    row = statistics.pairwise_u(df, "g", "v").first()
    assert (row["u_statistic"], row["auroc"]) == (2.0, pytest.approx(1 - 2 / 12))
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert float(tails.normal_two_sided(np.array(1.959964))) == pytest.approx(0.05, abs=1e-6)


def test_average_precision_is_step_wise(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.1)], "y int, s double")
    assert statistics.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx(1 / 3 + 3 / 4 * 2 / 3)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert statistics.adjusted_rand(df, "a", "b").first()["ari"] == 1.0


def test_bootstrap_is_repeatable_and_covers(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"))
    one, two = (statistics.bootstrap(df, "id", {"m": F.avg("x")}, resamples=100).first() for _ in range(2))
    assert one == two and one["m_lo"] < 4.5 < one["m_hi"]


def test_bootstrap_needs_enough_resamples(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"))
    assert statistics.bootstrap(df, "id", {"m": F.avg("x")}, resamples=10, at_least=20).first()["m_lo"] is None


def test_bootstrap_of_means_equals_that_of_copies(spark, monkeypatch):
    monkeypatch.setattr(statistics, "DRAWN", 20)
    rows = [(i, "a" if i % 3 else None, None if i % 7 == 0 else i * 1.5) for i in range(60)] + [(None, "a", 3.0), (10**60, "b", 4.0)]
    df = spark.createDataFrame([(None if i is None else str(i), g, x) for i, g, x in rows], "id string, g string, x double")
    found = {}
    for made in (statistics.bootstrap(df, "id", {"m": F.avg("x")}, 40, by=["g"]), statistics.bootstrap_means(df, "id", {"m": "x"}, 40, by=["g"])):
        for r in made.collect():
            found.setdefault(r["g"], []).append(r)
    assert set(found) == {"a", "b", None}
    for a, b in found.values():
        assert a["m_valid"] == b["m_valid"] and [a[c] for c in ("m_lo", "m_hi", "m_se")] == pytest.approx([b[c] for c in ("m_lo", "m_hi", "m_se")])


def test_bootstrap_of_means_skips_what_is_not_drawn(spark):
    """A million weights of a thousand rows in seconds, and an infinity counts only where it is drawn."""
    df = spark.range(1000).select("id", F.when(F.col("id") == 5, float("inf")).otherwise(1.0).alias("x"))
    row = statistics.bootstrap_means(df, "id", {"m": "x"}).first()
    assert row["m_lo"] == 1.0 and row["m_hi"] == float("inf") and row["m_valid"] == 1000


def test_lowess_follows_a_line_and_ignores_an_outlier(spark):
    df = spark.createDataFrame([("a", i, float(i), 2.0 * i + (50 if i == 10 else 0)) for i in range(30)], "g string, id int, x double, y double")
    smooth = {r["id"]: r["smooth"] for r in statistics.smoothed(df, "g", "id", "x", "y").collect()}
    assert all(abs(smooth[i] - 2 * i) < 0.5 for i in range(30))


def plain_lowess(x, y, share=0.5, rounds=3):
    k, robust = max(2, int(share * len(x) + 1e-10)), np.ones(len(x))
    for _ in range(rounds + 1):
        fit = np.empty(len(x))
        for i in range(len(x)):
            gap = np.abs(x - x[i])
            w = np.clip(1 - (gap / max(np.sort(gap)[k - 1], 1e-12)) ** 3, 0, None) ** 3 * robust
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            sxx = (w * (x - mx) ** 2).sum()
            fit[i] = my + ((w * (x - mx) * (y - my)).sum() / sxx * (x[i] - mx) if sxx > 1e-12 else 0)
        scale = 6 * np.median(np.abs(y - fit))
        robust = np.clip(1 - (np.abs(y - fit) / scale) ** 2, 0, None) ** 2
    return fit


@pytest.mark.parametrize("weights", [40, 2_000_000])
def test_lowess_equals_a_line_for_each_point(monkeypatch, weights):
    monkeypatch.setattr(arrays, "WEIGHTS", weights)
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=70), rng.integers(0, 9, 70).astype(float)):
        y = np.sin(x) + rng.normal(0, 0.2, 70)
        assert arrays.lowess(x, y) == pytest.approx(plain_lowess(x, y), abs=1e-9)


def test_lowess_of_many_points_of_few_values_needs_no_matrix():
    """A matrix of 60,000 points would take 29 GB."""
    x = np.arange(60_000.0) % 30
    assert arrays.lowess(x, 3 * x + 1) == pytest.approx(3 * x + 1)


def test_panels_and_scenarios(spark):
    columns = selection.PANELS["five"]["columns"]
    df = spark.createDataFrame([tuple(1.0 for _ in columns), tuple([None, *[1.0 for _ in columns[1:]]])], ", ".join(f"{c} double" for c in columns))
    row = selection.panel(df, "five").collect()
    assert len(row) == 1 and row[0]["import_insulin"] == pytest.approx(math.log(2)) and row[0]["import_hba1c"] == 1.0
    assert selection.minimal(["age", "sex_f", "hdl"], ["mage"], ["glu"])["4_both"] == ["age", "sex_f", "mage", "glu"]


def test_greedy_selection(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(x), float(2 * x + 0.01 * z), float(y), float(x + y), 1.0) for x, y, z in zip(a, b, rng.normal(size=200))]
    df = spark.createDataFrame(rows, "a double, a2 double, b double, ab double, flat double")
    found = selection.greedy(df, ["a", "a2", "b", "ab", "flat"])
    assert found.kept == ["a", "b"] and {d[0] for d in found.dropped} == {"a2", "ab", "flat"}
    assert set(selection.backward_vif(df, ["a", "b", "ab"]).kept) < {"a", "b", "ab"}


def test_ladder_stages():
    columns = ["age", "bmi", "race_a", "sex_f", "avg_daily_steps", "import_glucose", "import_hdl", "mage"]
    stages = selection.ladder(columns)
    assert list(stages) == ["1", "2", "3", "4", "5a", "5b", "6a", "6b"]
    assert stages["4"] == [
        "age", "race_a", "sex_f", "bmi", "avg_daily_steps", "import_hdl"
    ] and stages["5a"][-1] == "mage" and stages["6b"][-1] == "import_glucose"


def test_elastic_net_equals_coordinate_descent(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [3.0, -1.0, 0.0] + rng.normal(size=60)
    alpha, l1, w, c = 0.1, 0.5, np.zeros(3), y - y.mean()
    for _ in range(500):
        for j in range(3):
            r = c - x @ w + x[:, j] * w[j]
            z = x[:, j] @ r / 60
            w[j] = math.copysign(max(abs(z) - alpha * l1, 0), z) / (1 + alpha * (1 - l1))
    df = spark.createDataFrame(
        [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double"
    )
    fitted = models.fit_model(df, "id", ["a", "b", "c"], "y", "elastic_net", [models.elastic_settings(alpha, l1, float(y.std()))])
    assert list(fitted.coefficients().values()) == pytest.approx(w, abs=1e-4)


def test_importance_and_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(3 * a + 0.1 * e)) for i, (a, b, e) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    fitted = models.fit_model(df, "id", ["a", "b"], "y", "ols")
    loss = {r["feature"]: r["importance"] for r in models.permutation_importance(df, fitted, "y", "id", repeats=1).collect()}
    assert loss["a"] > 1 and abs(loss["b"]) < 0.05
    again = models.dealt(df, "a", "id", 0)
    assert again.count() == 300 and again.agg(F.sum("a")).first()[0] != pytest.approx(0, abs=1e-12)

    attributed = models.linear_attributions(df, fitted.coefficients(), "id")
    assert attributed.agg(F.sum("a")).first()[0] == pytest.approx(0, abs=1e-6)


def test_tree_attributions_add_up_to_predictions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(c), float(a * b + (c > 0) * 2)) for i, (a, b, c) in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    fitted = models.fit_model(df, "id", ["a", "b", "c"], "y", "boosted", [{"maxDepth": 3, "maxIter": 5, "stepSize": 0.3}])
    mean = expected(models.leaves(fitted.model))
    both = models.tree_attributions(df, fitted, "id").select(
        "id", (F.col("a") + F.col("b") + F.col("c")).alias("s")
    ).join(fitted.predict(df, "p"), "id").toPandas()
    assert (both["s"] + mean).to_numpy() == pytest.approx(both["p"].to_numpy(), abs=1e-9)


def test_leaf_attributions_equal_all_orders():
    from itertools import permutations

    leaf = Leaf(2.0, (0, 2), (0.0, -np.inf), (np.inf, 1.0), (0.4, 0.7))
    x = np.array([[1.0, 9.0, 2.0]])
    value = lambda known: 2.0 * (1.0 if 0 in known else 0.4) * (0.0 if 2 in known else 0.7)
    want = np.zeros(3)
    for order in permutations(range(3)):
        for k, f in enumerate(order):
            want[f] += (value(set(order[: k + 1])) - value(set(order[:k]))) / 6
    assert attributions([leaf], x)[0] == pytest.approx(want)


def test_groups_with_too_few_rows_or_one_class_are_skipped(spark):
    df = spark.createDataFrame([("a", i % 2) for i in range(20)] + [("b", i % 2) for i in range(19)] + [("c", 1)] * 25, "g string, y int")
    assert models.groups_to_fit(df, "g", "y") == ["a"]


def _blobs(spark):
    rng = np.random.default_rng(2)
    rows = [("g", i, *map(float, rng.normal(size=2) * 0.2 + (i % 2) * 5)) for i in range(40)]
    return spark.createDataFrame(rows, "grp string, id long, x double, y double")


@pytest.mark.parametrize("method", [cluster.ward, lambda *a: cluster.spectral(*a, neighbours=5)])
def test_matrix_clusterings_find_blobs(spark, method):
    found = {r["id"]: r["cluster"] for r in method(_blobs(spark), "grp", "id", ["x", "y"], 2).collect()}
    assert len({found[i] for i in range(0, 40, 2)}) == 1 and len({found[i] for i in range(1, 40, 2)}) == 1 and found[0] != found[1]


def test_silhouette_and_components(spark):
    df = _blobs(spark).withColumn("v", F.array("x", "y")).withColumn("label", F.col("id") % 2)
    assert pairs.silhouette(df, "id", "v", "label").agg(F.avg("silhouette")).first()[0] > 0.9
    near = pairs.neighbour_graph(df, "id", "v", 3)
    found = pairs.components(df.select("id"), near).groupBy("component").count().count()
    assert found >= 2


def test_blocks_give_the_same_neighbours(spark):
    df = _blobs(spark).withColumn("v", F.array("x", "y"))
    as_rows = lambda d: sorted((r["id"], r["place"], r["other"]) for r in d.collect())
    assert as_rows(pairs.neighbours(df, "id", "v", 3, block=7)) == as_rows(pairs.neighbours(df, "id", "v", 3))


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, study_group string, v double")
    df.write.parquet(f"{tmp_path}/base")
    new = spark.createDataFrame([(1, 9.0)], "id int, v double")
    assert io.upsert_features(spark, f"{tmp_path}/base", new, "id", f"{tmp_path}/next").first()["v"] == 9.0
    with pytest.raises(ValueError):
        io.upsert_features(spark, f"{tmp_path}/base", new, "id", f"{tmp_path}/base")
    for group in ("a", "b", "a"):  # the last one again
        io.append_results(df.withColumn("study_group", F.lit(group)), f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").count() == 2
    io.write_csv(df, f"{tmp_path}/csv")
    assert io.read_csv(spark, f"{tmp_path}/csv", ["id", "v"]).columns == ["id", "v"]
    assert io.load_meta(spark, f"{tmp_path}/meta.json") == {}
    io.save_meta(spark, f"{tmp_path}/meta.json", a=1)
    assert io.save_meta(spark, f"{tmp_path}/meta.json", b=[2]) == {"a": 1, "b": [2]}
    assert io.report(df, "{id}: {v:.1f}") == ["1: 2.0"]


def test_stream_equals_batch(spark, tmp_path):
    rows = io.synthetic_readings(spark, days=2).select(F.col("participant_id").alias("series"), "t", F.col("glucose").alias("g"))
    rows.write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = ranges.daily_time_in_range(stream).writeStream.format("memory").queryName("tir").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = ranges.daily_time_in_range(rows.withColumn("t", F.col("t").cast("timestamp")))
    assert sorted(map(tuple, spark.table("tir").collect())) == sorted(map(tuple, batch.collect()))
    lows = ranges.low_sessions(rows.withColumn("g", F.when(F.minute("t") < 20, 60.0).otherwise(100.0)))
    assert lows.count() > 0


def _bent(n, seed, copies=1):
    """Two bent strips, one within the other."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, np.pi, n)
    inner = np.arange(n) % 2 == 0
    x, y = np.where(inner, np.cos(t), 1 - np.cos(t)), np.where(inner, np.sin(t), 0.5 - np.sin(t))
    x, y = x + rng.normal(size=n) * 0.06, y + rng.normal(size=n) * 0.06
    return [(seed, int(c * 10_000 + seed * 1000 + i), float(x[i]), float(y[i])) for c in range(copies) for i in range(n)]


def _shares(found):
    """Clusters by key, without their numbers."""
    of = {}
    for r in found.collect():
        of.setdefault((r["grp"], r["cluster"]), set()).add(r["id"])
    return {frozenset(s) for s in of.values()}


def test_spectral_clusters_of_large_groups_equal_those_of_a_matrix(spark, monkeypatch):
    df = spark.createDataFrame(_bent(160, 1) + _bent(30, 3), "grp int, id long, x double, y double")
    want = _shares(cluster.spectral(df, "grp", "id", ["x", "y"], 2, neighbours=6))
    monkeypatch.setattr(cluster, "MATRIX_ROWS", 100)
    for name, value in (("LEAF", 40), ("SEEDS", 4), ("WIDE", 64)):
        monkeypatch.setattr(spectral, name, value)
    got = _shares(cluster.spectral(df, "grp", "id", ["x", "y"], 2, neighbours=6))
    assert len(got) == 4 and got == want


def test_spectral_clusters_of_copies_equal_those_of_one(spark):
    """Copies are no neighbours that hide others, and a group of many rows is no error."""
    df = spark.createDataFrame(_bent(200, 1, 30), "grp int, id long, x double, y double")
    one = _shares(cluster.spectral(df.where("id < 10000"), "grp", "id", ["x", "y"], 2))
    assert {frozenset(i for i in s if i < 10_000) for s in _shares(cluster.spectral(df, "grp", "id", ["x", "y"], 2))} == one
