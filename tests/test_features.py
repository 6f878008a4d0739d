"""Feature formulas against hand-checked values and properties."""

import datetime as dt
import math

import numpy as np
import pytest

from tidewater.functions.arrays import sample_entropy, spectrum
from tidewater.operators import glucose, series
from tidewater.sources import io

SPEC = series.SeriesSpec("id", "t", "g", "tie", min_readings=1)
START = dt.datetime(2024, 1, 1)


def readings(spark, values, step=300, start=START, key="a"):
    rows = [(key, start + dt.timedelta(seconds=step * i), None if v is None else float(v), i) for i, v in enumerate(values)]
    return series.readings(spark.createDataFrame(rows, "id string, t timestamp_ntz, g double, tie long"), SPEC)


@pytest.mark.parametrize(
    "values, expected", [([100, 150, 90, 160, 95], 61.25), ([100, 120, 120, 110], 10.0), ([100, 101, 102, 103], 3.0)]
)
def test_mage(spark, values, expected):
    assert glucose.excursions(readings(spark, values), SPEC).first()["mage"] == pytest.approx(expected)


def test_mage_of_a_constant_series_is_unknown(spark):
    assert glucose.excursions(readings(spark, [120] * 6), SPEC).first()["mage"] is None


@pytest.mark.parametrize(
    "value, low, high",
    [(10, 100.041508, 0), (20, 100.041508, 0), (54, 18.461365, 0), (70, 7.755206, 0), (180, 0, 7.729312), (250, 0, 22.436200), (700, 0, 99.948051)]
)
def test_risk(spark, value, low, high):
    row = glucose.per_series(readings(spark, [value, value]), SPEC, glucose.risk()).first()
    assert (row["lbgi"], row["hbgi"]) == (pytest.approx(low, abs=1e-5), pytest.approx(high, abs=1e-5))


@pytest.mark.parametrize("mmol, expected", [(0.5, None), (1.0, 50), (5, 0.008448), (8, 5.692310), (10, 10.88), (20, 31.974249)])
def test_grade(spark, mmol, expected):
    got = glucose.per_series(readings(spark, [mmol * 18] * 2), SPEC, glucose.grade()).first()["grade"]
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-4)


def test_m_value(spark):
    got = [glucose.per_series(readings(spark, [v] * 2), SPEC, glucose.m_value()).first()["m_value"] for v in (60, 120, 240)]
    assert got == pytest.approx([27.279055, 0, 27.279055], abs=1e-5)


def test_m_value_with_a_reading_of_zero_is_infinite(spark):
    assert glucose.per_series(readings(spark, [120, 0, 100]), SPEC, glucose.m_value()).first()["m_value"] == math.inf


def test_percentiles(spark):
    row = glucose.per_series(readings(spark, [45, 45, 90, 100, 110, 150, 180, 260]), SPEC, glucose.percentiles()).first()
    assert [row[f"p{p}_glucose"] for p in (10, 25, 75, 90)] == pytest.approx([45, 78.75, 157.5, 204])


def test_sample_entropy():
    assert sample_entropy(np.array([1.0, 2, 3] * 4)) == pytest.approx(0.223144, abs=1e-6)
    assert sample_entropy(np.full(20, 5.0)) is None


def test_cosinor_finds_the_peak_hour(spark):
    values = [120 + 30 * math.cos(2 * math.pi * (i / 12 - 8) / 24) for i in range(288)]
    row = glucose.per_series(readings(spark, values), SPEC, glucose.cosinor(SPEC)).first()
    assert (row["cosinor_mesor"], row["cosinor_amplitude"], row["cosinor_acrophase_h"]) == pytest.approx((120, 30, 8), abs=1e-6)


def test_grid_rounds_half_to_even_and_keeps_the_last(spark):
    rows = [("a", START + dt.timedelta(seconds=s), float(i), i) for i, s in enumerate((0, 149, 150, 151, 450, 750, 1500))]
    slots = series.grid(series.readings(spark.createDataFrame(rows, "id string, t timestamp_ntz, g double, tie long"), SPEC), SPEC)
    assert {r["slot"]: r["g"] for r in slots.collect()} == {0: 2.0, 1: 3.0, 2: 5.0, 5: 6.0}


def test_a_reading_that_rounds_past_the_end_is_dropped(spark):
    rows = [("a", START + dt.timedelta(seconds=s), 1.0, s) for s in (0, 300, 580)]
    slots = series.grid(series.readings(spark.createDataFrame(rows, "id string, t timestamp_ntz, g double, tie long"), SPEC), SPEC)
    assert sorted(r["slot"] for r in slots.collect()) == [0, 1]


def test_episodes_need_three_readings_and_count_an_open_end(spark):
    values = [60, 60, 100, 60, 60, 60, 100, 190, 190, 190, 190]
    row = glucose.episodes(readings(spark, values), SPEC).first()
    assert row.asDict() == {"series": "a", "n_hypo_events": 1, "mean_hypo_dur_min": 15.0, "n_hyper_events": 1, "mean_hyper_dur_min": 20.0}


def test_unknown_values_are_left_out(spark):
    rows = readings(spark, [100, None, float("nan"), float("inf"), 110])
    assert sorted(r["g"] for r in rows.collect()) == [100.0, 110.0]


def test_properties_of_a_synthetic_series(spark):
    spec = series.SeriesSpec("participant_id", "t", "glucose", "reading")
    rows = series.readings(io.synthetic_readings(spark, days=4), spec)
    row = glucose.feature_table(rows, spec).first().asDict()
    assert set(row) == {"series", *glucose.ORDER}
    assert row["tir_70_180_pct"] + row["tbr_lt70_pct"] + row["tar_gt180_pct"] == pytest.approx(100, abs=0.11)
    assert row["tbr_lt54_pct"] <= row["tbr_lt70_pct"] and row["tar_gt250_pct"] <= row["tar_gt180_pct"]
    assert all(row[c] is not None for c in ("mage", "sample_entropy", "dfa_alpha", "modd", "conga6", "cosinor_amplitude", "spectral_entropy"))


def test_series_under_the_minimum_are_left_out(spark):
    spec = series.SeriesSpec("id", "t", "g", "tie")
    rows = readings(spark, [100 + i % 7 for i in range(47)]).union(readings(spark, [100 + i % 7 for i in range(48)], key="b"))
    assert [r["series"] for r in glucose.feature_table(rows, spec).collect()] == ["b"]


def test_spectrum_of_a_daily_wave():
    slot = np.arange(24 * 12 * 4)
    share, period, entropy = spectrum(slot, 100 + 20 * np.cos(2 * np.pi * slot / 288), len(slot), 5, 288)
    assert (share, period) == (pytest.approx(1), pytest.approx(24)) and entropy < 0.05
