"""The sensor job over growing input: only new files are read, late readings and corrections land in
their own days and weeks, and reruns change nothing."""

import datetime as dt
import json
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import sensor_summaries
from jobs.common import settings

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double, event_type string"
DAY0 = dt.datetime(2024, 2, 28)


def draw(rng, n, first, days, ids):
    return [
        (
            ids + i, DAY0 + dt.timedelta(days=first + rng.random() * days), rng.randrange(5),
            rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.1 else round(rng.uniform(40, 300), 1), "EGV"
        )
        for i in range(n)
    ]


def expected(uploads):
    """What all uploads say, by plain dictionaries."""
    said = {}
    for rows in uploads:
        batch = {}
        for event, t, user, value, _ in rows:
            if value is not None and np.isfinite(value) and user is not None and t is not None:
                batch[user, t, event] = max(value, batch.get((user, t, event), -np.inf))
        said |= batch
    out = {}
    for (user, t, _), g in said.items():
        day = t.date()
        for level, start in (("day", day), ("week", day - dt.timedelta(days=day.weekday()))):
            out.setdefault((level, start, user), []).append(g)
    return {k: (len(g), np.mean(g), np.median(g), 100 * np.mean([70 <= x <= 180 for x in g])) for k, g in out.items()}


class Site:
    """One place with its uploads, state, output and checkpoint."""

    def __init__(self, spark, path, **config):
        self.spark, self.path, self.config = spark, path, settings("sensor_summaries") | config
        self.uploads = []

    def upload(self, rows):
        self.uploads.append(rows)
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, checkpoint="checkpoint"):
        return sensor_summaries.run(
            self.spark, f"{self.path}/in", f"{self.path}/readings", f"{self.path}/out", f"{self.path}/{checkpoint}", self.config
        )

    def stands(self):
        rows = sensor_summaries.result(self.spark, f"{self.path}/out").collect()
        assert len({(r["level"], r["start"], r["series"]) for r in rows}) == len(rows)
        for r in rows:
            assert r["active_pct"] == pytest.approx(100 * r["n_readings"] / (288 * (7 if r["level"] == "week" else 1)))
        return {(r["level"], r["start"], r["series"]): (r["n_readings"], r["mean_glucose"], r["median_glucose"], r["tir_70_180_pct"]) for r in rows}

    def check(self):
        got, want = self.stands(), expected(self.uploads)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])

    def written(self):
        rows = self.spark.read.parquet(f"{self.path}/out").select("level", "start", F.col("_metadata.file_path").alias("file"))
        return {(r["level"], r["start"], r["file"]) for r in rows.distinct().collect()}


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def test_two_runs_over_growing_input(site):
    rng = random.Random(1)
    site.upload(draw(rng, 300, 0, 20, 0))
    assert site.run()["read"] == 300
    site.check()
    before = site.written()
    late = draw(rng, 8, 3, 1, 1000)
    new = draw(rng, 60, 20, 4, 2000)
    corrected = [(e, t, u, 111.0, k) for e, t, u, v, k in site.uploads[0][:3] if v is not None]
    site.upload(late + new + corrected)
    done = site.run()
    assert done["read"] == len(late + new + corrected)
    site.check()
    # Only weeks that the second upload touches were written again.
    touched = {r[1].date() - dt.timedelta(days=r[1].weekday()) for r in late + new + corrected}
    changed = {(level, start) for level, start, _ in before - site.written()}
    assert changed and all(start - dt.timedelta(days=start.weekday()) in touched for _, start in changed)
    kept = {(level, start) for level, start, _ in before & site.written()}
    assert kept


def test_rerun_without_news_reads_nothing(site):
    site.upload(draw(random.Random(2), 100, 0, 5, 0))
    site.run()
    before = site.written(), site.stands()
    assert site.run() == {"batches": 0, "read": 0, "known": 0, "written": 0}
    assert (site.written(), site.stands()) == before


def test_lost_checkpoint_gives_the_same(site):
    rng = random.Random(3)
    for i in range(3):
        site.upload(draw(rng, 40, 2 * i, 3, 100 * i))
        site.run()
    site.check()
    assert site.run("another")["read"] == 120
    site.check()


def test_stopped_batch_is_taken_again(site, monkeypatch):
    rng = random.Random(4)
    site.upload(draw(rng, 80, 0, 6, 0))
    plain = sensor_summaries.summaries

    def stop(*_):
        raise RuntimeError("stopped between readings and summaries")

    monkeypatch.setattr(sensor_summaries, "summaries", stop)
    with pytest.raises(Exception, match="stopped between"):
        site.run()
    monkeypatch.setattr(sensor_summaries, "summaries", plain)
    assert site.run()["batches"] == 1
    site.check()
    assert site.spark.read.parquet(f"{site.path}/readings").count() == sum(k for (level, *_), (k, *_) in site.stands().items() if level == "day")


def test_batches_of_files_and_unknown_readings(spark, tmp_path):
    site = Site(spark, tmp_path, files_per_batch=1)
    rng = random.Random(5)
    for i in range(3):
        site.upload(draw(rng, 30, i, 2, 100 * i))
    site.upload([(900, DAY0, None, 100.0, "EGV"), (901, None, 1, 100.0, "EGV"), (902, DAY0, 1, None, "EGV")])
    done = site.run()
    assert done["batches"] == 4 and done["read"] == 93
    assert site.stands().keys() == expected(site.uploads).keys()


def test_filter_of_readings(spark, tmp_path):
    site = Site(spark, tmp_path, where="event_type = 'EGV'")
    rows = draw(random.Random(6), 60, 0, 3, 0)
    site.upload([(*r[:4], "EGV" if i % 2 else "meal") for i, r in enumerate(rows)])
    site.run()
    site.uploads = [[r for r in site.uploads[0] if r[4] == "EGV"]]
    site.check()


def test_scan_reads_the_weeks_it_needs(site):
    rng = random.Random(7)
    site.upload(draw(rng, 200, 0, 60, 0))
    site.run()
    kept = site.spark.read.parquet(f"{site.path}/readings")
    plan = kept.where(F.col("day").between(F.lit(dt.date(2024, 3, 4)), F.lit(dt.date(2024, 3, 10))))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_command_line(spark, tmp_path):
    site = Site(spark, tmp_path)
    site.upload(draw(random.Random(8), 50, 0, 2, 0))
    (tmp_path / "config.json").write_text(json.dumps({"where": "event_type = 'EGV'"}))
    paths = [
        x for n,
        p in (("source", "in"), ("readings", "readings"), ("output", "out"), ("checkpoint", "checkpoint")) for x in (f"--{n}", str(tmp_path / p))
    ]
    run = subprocess.run(
        [sys.executable, "-m", "jobs.sensor_summaries", *paths, "--config", str(tmp_path / "config.json")], capture_output=True,
        text=True, timeout=300
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert '"read": 50' in run.stderr
    site.check()


def test_unknown_settings_are_refused(tmp_path):
    (tmp_path / "c.json").write_text('{"interval": 5}')
    with pytest.raises(ValueError, match="interval"):
        settings("sensor_summaries", str(tmp_path / "c.json"))
