"""Clusterings of many runs against plain ones on arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import batched, resampling
from tidewater.operators.batched import Run


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.6, (n, 2)) for m, n in (((0, 0), 50), ((4, 1), 40), ((1, 5), 30))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, float("nan"), 1.0), (None, 1.0, 1.0)], "id long, a double, b double").repartition(4)
    numbers = dict(df.where("id < 900").select("id", resampling.key_number(F.col("id"))).collect())
    return x, np.array([numbers[i] for i in range(len(x))]), df


def plain_lloyd(x, w, centres, iterations=300):
    for _ in range(iterations):
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        own = d.argmin(1)
        moved = np.stack([np.average(x[own == c], axis=0, weights=w[own == c]) if w[own == c].sum() else centres[c] for c in range(len(centres))])
        if np.abs(moved - centres).max() <= 1e-8:
            break
        centres = moved
    d = ((x[:, None] - moved[None]) ** 2).sum(2)
    return moved, (w * d.min(1)).sum()


def test_all_runs_equal_plain_ones(data, monkeypatch):
    monkeypatch.setattr(batched, "BLOCK", 100)
    x, numbers, df = data
    runs = [Run(k, s, b) for k in (1, 2, 3, 4) for s, b in ((0, 0), (1, 0), (0, 2))]
    rows = batched.points(df, "id", ["a", "b"])
    starts = batched.first_centres(rows, runs, 2)
    for run, start, found in zip(runs, starts, batched.kmeans(rows, runs)):
        w = resampling.weights(numbers, 2)[:, run.resample - 1] if run.resample else np.ones(len(x))
        assert len({tuple(c) for c in start}) == run.k and all((np.abs(x - c).max(1) == 0).any() for c in start)
        centres, cost = plain_lloyd(x, w, start)
        assert found.centres == pytest.approx(centres, abs=1e-6) and found.cost == pytest.approx(cost, rel=1e-6)


def test_partitions_do_not_matter(data):
    _, _, df = data
    a, b = (batched.kmeans(batched.points(f, "id", ["a", "b"]), [Run(3, s) for s in range(4)]) for f in (df, df.coalesce(1)))
    assert all(u.centres == pytest.approx(v.centres) for u, v in zip(a, b))
    assert len({round(u.cost, 6) for u in a}) >= 1


def test_points_are_dealt_to_all_cores(spark, data):
    """However few partitions their bytes make."""
    assert batched.points(data[2].coalesce(1), "id", ["a", "b"]).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_passes_of_resamples_draw_no_weights(data, monkeypatch):
    """Stored weights are those that are drawn, and stand for them."""
    _, _, df = data
    rows = batched.points(df, "id", ["a", "b"])
    number = np.array([r["number"] for r in rows.collect()])
    kept = {r["number"]: np.frombuffer(r["drawn"], np.uint8) for r in batched._weighed(rows, 5).collect()}
    assert (np.stack([kept[n] for n in number]) == resampling.weights(number, 5)).all()
    runs = [Run(2, 0, 3), Run(2, 0, 0)]
    assert (batched._weight(np.stack([kept[n] for n in number]), runs) == batched._weight(number, runs)).all()


def test_elbow_and_labels(data):
    x, _, df = data
    table, best = batched.elbow(df, "id", ["a", "b"], range(1, 6), starts=10)
    cost = {r["k"]: r["cost"] for r in table.collect()}
    assert cost[1] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and all(cost[k] > cost[k + 1] for k in range(1, 5))
    rows = batched.labelled(df, ["a", "b"], {"cluster": best[3].centres, "pair": best[2].centres}).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["id"] is not None and r["id"] < len(x):
            assert r["cluster"] == ((best[3].centres - x[r["id"]]) ** 2).sum(1).argmin()
    assert [r["cluster"] for r in rows if r["id"] in (900, 901)] == [None, None]


def test_stability_equals_pairs(data):
    x, numbers, df = data
    labelled = df.where("id < 900").withColumn("own", F.when(F.col("id") < 50, 0).when(F.col("id") < 90, 1).otherwise(2)).na.drop()
    got = {r["original"]: r["stability"] for r in batched.stability(labelled, "id", ["a", "b"], "own", 4, resamples=12).collect()}
    runs = [Run(4, 0, b + 1) for b in range(12)]
    found = batched.kmeans(batched.points(labelled, "id", ["a", "b"]), runs)
    w = resampling.weights(numbers, 12)
    for g, members in ((0, range(50)), (1, range(50, 90)), (2, range(90, 120))):
        same = all_ = 0
        for b, f in enumerate(found):
            own = ((x[:, None] - f.centres[None]) ** 2).sum(2).argmin(1)
            drawn = [i for i in members if w[i, b]]
            pairs = [(i, j) for i in drawn for j in drawn if i < j]
            same, all_ = same + sum(own[i] == own[j] for i, j in pairs), all_ + len(pairs)
        assert got[g] == pytest.approx(same / all_)


def plain_em(x, own, k, tol, iterations=100):
    resp, before = (own[:, None] == np.arange(k)).astype(float), -np.inf
    for _ in range(iterations + 1):
        n = resp.sum(0)
        mean = resp.T @ x / n[:, None]
        cov = np.stack([(resp[:, c, None] * (x - mean[c])).T @ (x - mean[c]) / n[c] + 1e-6 * np.eye(x.shape[1]) for c in range(k)])
        if before is None:
            break
        dens = np.stack(
            [
                n[c] / n.sum() * np.exp(
                    -0.5 * np.einsum("ni,ij,nj->n", x - mean[c], np.linalg.inv(cov[c]), x - mean[c])
                ) / np.sqrt((2 * np.pi) ** x.shape[1] * np.linalg.det(cov[c])) for c in range(k)
            ],
            1
        )
        like = np.log(dens.sum(1)).mean()
        resp = dens / dens.sum(1, keepdims=True)
        if like - before < tol:
            before = None
        else:
            before = like
    return mean, cov


def test_mixtures_equal_plain_ones(data):
    x, _, df = data
    rows = batched.points(df, "id", ["a", "b"])
    starts = batched.kmeans(rows, [Run(3, s) for s in range(3)])
    for start, found in zip(starts, batched.mixtures(rows, starts)):
        own = ((x[:, None] - start.centres[None]) ** 2).sum(2).argmin(1)
        mean, cov = plain_em(x, own, 3, 1e-3)
        assert found.mean == pytest.approx(mean, abs=1e-5) and found.covariance == pytest.approx(cov, abs=1e-5)
        assert found.share.sum() == pytest.approx(1)
    rows = batched.mixed(df, ["a", "b"], found).where("id < 900 AND component IS NOT NULL").collect()
    assert all(1 / 3 <= r["posterior"] <= 1 and r["ambiguous"] == (r["posterior"] < 0.6) for r in rows) and len(rows) == len(x)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "id long, a double, b double")
    (found,) = batched.kmeans(batched.points(df, "id", ["a", "b"]), [Run(3)])
    assert found.cost == 0.0 and found.centres.tolist() == [[1.0, 2.0]] * 3
    (none,) = batched.kmeans(batched.points(df.where("false"), "id", ["a", "b"]), [Run(2)])
    assert none.cost == 0.0
