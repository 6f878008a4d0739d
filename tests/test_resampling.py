"""Resampled metrics against plain weighted ranks, for every resample."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import resampling

B = 40


def plain(w, y, s):
    pos, neg = w * (y > 0), w * (y <= 0)
    if not pos.sum() or not neg.sum():
        return None, None
    u = sum(pos[i] * (neg[s < s[i]].sum() + neg[s == s[i]].sum() / 2) for i in range(len(s)))
    ap = 0.0
    for t in np.unique(s):
        tp, fp = pos[s >= t].sum(), neg[s >= t].sum()
        ap += pos[s == t].sum() / pos.sum() * (tp / (tp + fp) if tp + fp else 0)
    return u / pos.sum() / neg.sum(), ap


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(2)), float(rng.choice([0.5, rng.integers(12) / 4])), "ab"[int(rng.integers(2))]) for i in range(160)]
    rows += [(200 + i, 1, float(i), "one class") for i in range(5)] + [(300, 0, float(i), "few") for i in range(1)] + [(301, 1, 2.0, "few")]
    more = [(400, None, 1.0, "a"), (401, 1, None, "a"), (402, 1, float("nan"), "a"), (None, 1, 1.0, "a")]
    df = spark.createDataFrame(rows + more, "id long, y int, s double, g string").repartition(4)
    numbers = dict(df.where("id IS NOT NULL").select("id", resampling.key_number(F.col("id"))).collect())
    return rows, df, numbers


@pytest.mark.parametrize("together", [2, 10**9])
def test_ranked_equals_plain(data, together, monkeypatch):
    rows, df, numbers = data
    monkeypatch.setattr(resampling, "TOGETHER", together)
    monkeypatch.setattr(resampling, "BLOCK", 100)
    got = {(r["g"], r["resample"]): (r["auroc"], r["average_precision"]) for r in resampling.ranked(df, "id", "y", "s", "g", B, seed=3).collect()}
    assert len(got) == 4 * B
    for g in ("a", "b", "one class", "few"):
        mine = [r for r in rows if r[3] == g]
        w = resampling.weights(np.array([numbers[r[0]] for r in mine]), B, 3)
        y, s = np.array([r[1] for r in mine]), np.array([r[2] for r in mine])
        for b in range(B):
            want = plain(w[:, b], y, s)
            assert got[g, b + 1] == (pytest.approx(want) if want[0] is not None else (None, None))
    assert all(got["one class", b + 1] == (None, None) for b in range(B))
    assert len({got["few", b + 1][0] for b in range(B)}) == 2


def test_partitions_do_not_matter(data):
    _, df, _ = data
    a, b = (sorted(map(str, resampling.ranked(f, "id", "y", "s", None, 10).collect())) for f in (df, df.coalesce(1)))
    assert a == b and len(a) == 10


def test_regression_equals_plain(data, monkeypatch):
    rows, df, numbers = data
    monkeypatch.setattr(resampling, "BLOCK", 90)
    got = {(r["g"], r["resample"]): (r["r2"], r["mse"]) for r in resampling.regression(df.where("g <> 'few'"), "id", "s", "y", "g", B).collect()}
    for g in ("a", "b", "one class"):
        mine = [r for r in rows if r[3] == g]
        w = resampling.weights(np.array([numbers[r[0]] for r in mine]), B)
        f, y = np.array([r[1] for r in mine], float), np.array([r[2] for r in mine])
        for b in range(B):
            n = w[:, b].sum()
            if not n:
                assert got[g, b + 1] == (None, None)
                continue
            mean = (w[:, b] * y).sum() / n
            spread, error = (w[:, b] * (y - mean) ** 2).sum(), (w[:, b] * (y - f) ** 2).sum()
            assert got[g, b + 1][1] == pytest.approx(error / n)
            assert got[g, b + 1][0] == (pytest.approx(1 - error / spread) if spread > 1e-9 else None)


def test_intervals_and_guard(data):
    _, df, _ = data
    each = resampling.ranked(df, "id", "y", "s", "g", B)
    rows = {(r["g"], r["metric"]): r for r in resampling.intervals(each, ["auroc"], "g", at_least=30).collect()}
    values = [r["auroc"] for r in each.where("g = 'a'").collect()]
    assert rows["a", "auroc"]["lo"] == pytest.approx(np.percentile(values, 2.5)) and rows["a", "auroc"]["se"] == pytest.approx(np.std(values, ddof=1))
    assert rows["few", "auroc"]["valid"] < 30 and rows["few", "auroc"]["lo"] is None and rows["one class", "auroc"]["valid"] == 0


def test_weights_are_poisson_and_equal_sql():
    number = np.random.default_rng(5).integers(0, 2**52, 4000)
    w = resampling.weights(number, 300)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    columns = np.corrcoef(w[:, :60].T) - np.eye(60)
    lines = np.corrcoef(w[:60]) - np.eye(60)
    assert abs(columns).max() < 0.08 and abs(lines).max() < 0.3
    con = duckdb.connect()
    sql = resampling.weight_sql("n", "r", 2)
    want = resampling.weights(number[:50], 20, 2)
    got = con.execute(
        f"SELECT {sql} FROM (SELECT unnest({number[:50].tolist()}) AS n), range(1, 21) AS t(r) ORDER BY list_position({number[:50].tolist()}, n), r"
    ).fetchall()
    assert [g[0] for g in got] == want.ravel().tolist()


def test_empty(spark):
    df = spark.createDataFrame([], "id long, y int, s double")
    assert resampling.ranked(df, "id", "y", "s", None, 5).count() == 0
    assert resampling.regression(df, "id", "y", "s", None, 5).count() == 0


def test_rates_equal_plain(data):
    rows, df, numbers = data
    df = df.withColumn("p", (F.col("s") > 0.5).cast("int"))
    got = {(r["g"], r["resample"]): r for r in resampling.rates(df.where("s IS NOT NULL AND NOT isnan(s)"), "id", "y", "p", "g", B).collect()}
    for g in ("a", "b", "one class"):
        mine = [r for r in rows if r[3] == g]
        w = resampling.weights(np.array([numbers[r[0]] for r in mine]), B)
        y, p = np.array([r[1] for r in mine]), np.array([r[2] > 0.5 for r in mine])
        for b in range(B):
            for name, c in (("sensitivity", y == 1), ("specificity", y == 0)):
                n = (w[:, b] * c).sum()
                want = (w[:, b] * c * (p == (name == "sensitivity"))).sum() / n if n else None
                assert got[g, b + 1][name] == (pytest.approx(want) if n else None)


def test_ranked_resamples_hold_bounded_blocks_of_scores(spark, monkeypatch):
    """Also where all scores differ, and where a score's rows travel as sums: same values, small blocks."""
    rng = random.Random(31)
    rows = [(i, int(rng.random() < 0.3), rng.random() if i % 3 else 0.5) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int, p double").repartition(2)
    want = resampling.ranked(df, "id", "y", "p", resamples=50).orderBy("resample").collect()
    monkeypatch.setattr(resampling, "BLOCK", 50 * 7)
    got = resampling.ranked(df, "id", "y", "p", resamples=50).orderBy("resample").collect()
    for a, b in zip(want, got, strict=True):
        assert a["auroc"] == pytest.approx(b["auroc"], abs=1e-12) and a["average_precision"] == pytest.approx(b["average_precision"], abs=1e-12)
    table = pa.table({"g": [""] * 900, "score": [p for _, _, p in rows], "label": [y for _, y, _ in rows], "number": [i for i, _, _ in rows], "sums": pa.array([None] * 900, pa.binary())})
    for down in (False, True):
        (name, blocks), = resampling._levels(table, 50, 0, down)
        sizes = [len(pos) for pos, neg in blocks if pos.shape == neg.shape]
        assert name == "" and max(sizes) == 7 and sum(sizes) == len({p for _, _, p in rows})
