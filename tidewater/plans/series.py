"""Queries of series features. Users are series of raw readings; event types, on an hourly grid,
are the series of daily, grid and complexity features (users have too few readings a day)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.operators import glucose, series
from tidewater.plans.registry import ORACLES, query, rounded, table

USERS = series.SeriesSpec("user_id", "ts", "value", "event_id")
TYPES = series.SeriesSpec("event_type", "ts", "value", "event_id", interval_min=60)


def _rows(spark: SparkSession, sf_dir: str, spec: series.SeriesSpec, where: Column | None = None) -> DataFrame:
    return series.readings(table(spark, sf_dir, "events"), spec, where)


# DuckDB: readings r, and those k of series with enough of them.
def _base(key: str, where: str = "true") -> str:
    return (
        f"WITH r AS (SELECT {key} AS series, ts AS t, event_id AS tie, value AS g FROM events WHERE value IS NOT NULL AND isfinite(value) AND {where}), "
        "k AS (SELECT * FROM r WHERE series IN (SELECT series FROM r GROUP BY series HAVING count(*) >= 48)) "
    )


_GRID = """, s AS (SELECT series, t, tie, g, epoch_us(t) AS us, min(epoch_us(t)) OVER (PARTITION BY series) AS u0, max(epoch_us(t)) OVER (PARTITION BY series) AS u1 FROM k),
p AS (SELECT series, t, tie, g, round_even((us - u0) / 1e6 / 3600, 0)::BIGINT AS slot, floor((u1 - u0) / 1e6 / 3600)::BIGINT + 1 AS slots FROM s),
d AS (SELECT series, slot, arg_max(g, (t, tie)) AS g, any_value(slots) AS slots FROM p WHERE slot < slots GROUP BY series, slot)"""
_PCT = "avg(CASE WHEN {} THEN 100e0 ELSE 0e0 END)"
_HOD = "(hour(t) + minute(t) / 60e0)"
_BG = "(1.509e0 * (pow(ln(least(greatest(g, 20e0), 600e0)), 1.084e0) - 5.381e0))"
_LOW, _HIGH = f"(CASE WHEN {_BG} < 0 THEN 10 * {_BG} * {_BG} ELSE 0e0 END)", f"(CASE WHEN {_BG} > 0 THEN 10 * {_BG} * {_BG} ELSE 0e0 END)"
_HYPO = f"({_PCT.format('g < 54')} + 0.8e0 * {_PCT.format('g >= 54 AND g < 70')})"
_HYPER = f"({_PCT.format('g > 250')} + 0.5e0 * {_PCT.format('g > 180 AND g <= 250')})"

RAW: dict[str, tuple[Callable[[], dict[str, Column]], dict[str, str]]] = {
    "cgm_central": (
        glucose.central,
        {
            "mean_glucose": "avg(g)", "sd_glucose": "stddev_samp(g)", "cv_pct": "100 * stddev_samp(g) / nullif(avg(g), 0)",
            "min_glucose": "min(g)", "max_glucose": "max(g)", "range_glucose": "max(g) - min(g)"
        },
    ),
    "cgm_percentiles": (
        glucose.percentiles,
        {f"p{p}_glucose": f"quantile_cont(g, {p / 100})" for p in (10, 25, 75, 90)} | {
            "median_glucose": "quantile_cont(g, 0.5)", "iqr_glucose": "quantile_cont(g, 0.75) - quantile_cont(g, 0.25)"
        },
    ),
    "cgm_moments": (glucose.moments, {}),
    "cgm_time_in_range": (
        glucose.time_in_range,
        {
            "tir_70_180_pct": _PCT.format("g >= 70 AND g <= 180"), "tbr_lt70_pct": _PCT.format("g < 70"), "tbr_lt54_pct": _PCT.format("g < 54"),
            "tar_gt180_pct": _PCT.format("g > 180"), "tar_gt250_pct": _PCT.format("g > 250"), "tight_70_140_pct": _PCT.format("g >= 70 AND g <= 140"),
        },
    ),
    "cgm_gmi_jindex": (glucose.indices, {"gmi_pct": "3.31e0 + 0.02392e0 * avg(g)", "j_index": "0.001e0 * pow(avg(g) + stddev_samp(g), 2)"}),
    "cgm_mvalue": (glucose.m_value, {"m_value": "avg(pow(abs(10 * log10(g / 120e0)), 3))"}),
    "cgm_risk_lbgi_hbgi": (glucose.risk, {"lbgi": f"avg({_LOW})", "hbgi": f"avg({_HIGH})"}),
    "cgm_gri": (glucose.glycemia_risk, {"gri": f"least(3e0 * {_HYPO} + 1.6e0 * {_HYPER}, 100e0)", "gri_hypo_comp": _HYPO, "gri_hyper_comp": _HYPER}),
    "cgm_circadian_windows": (
        glucose.windows_of_day,
        {
            "overnight_mean": f"avg(g) FILTER ({_HOD} < 6)", "daytime_mean": f"avg(g) FILTER ({_HOD} >= 6)", "dawn_rise": f"avg(g) FILTER ({_HOD} >= 6 AND {_HOD} < 9) - avg(g) FILTER ({_HOD} < 6)",
            "nocturnal_hypo_pct": f"avg(CASE WHEN g < 70 THEN 100e0 ELSE 0e0 END) FILTER ({_HOD} < 6)",
        },
    ),
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"round_even({e}, 9) AS {n}" for n, e in columns.items())


def _raw_oracle(name: str, key: str) -> str:
    if name == "cgm_moments":  # population moments, written out
        return _base(key) + (
            ", m AS (SELECT series, g - avg(g) OVER (PARTITION BY series) AS d FROM k), "
            "c AS (SELECT series, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM m GROUP BY series) "
            "SELECT series, CASE WHEN m2 > 0 THEN round_even(m3 / pow(m2, 1.5), 9) END AS skewness, CASE WHEN m2 > 0 THEN round_even(m4 / (m2 * m2) - 3, 9) END AS kurtosis FROM c"
        )
    return f"{_base(key)} SELECT series, {_select(RAW[name][1])} FROM k GROUP BY series"


for _name, (_family, _) in RAW.items():

    def _raw(spark: SparkSession, sf_dir: str, family: Callable[[], dict[str, Column]] = _family) -> DataFrame:
        return rounded(glucose.per_series(_rows(spark, sf_dir, USERS), USERS, family()))

    query(_name, _raw_oracle(_name, "user_id"))(_raw)


@query(
    "cgm_coverage",
    _base("user_id")
    + """SELECT series, count(*) AS qc_n_egv, round_even((max(epoch_us(t)) - min(epoch_us(t))) / 1e6 / 86400, 9) AS qc_wear_span_days, count(DISTINCT t::DATE) AS qc_n_days,
round_even(100e0 * count(*) / ((max(epoch_us(t)) - min(epoch_us(t))) / 1e6 / 86400 * 288), 9) AS qc_pct_active FROM k GROUP BY series""",
)
def cgm_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.per_series(_rows(spark, sf_dir, USERS), USERS, glucose.coverage(USERS)))


@query(
    "cgm_mad",
    _base("user_id") + ", m AS (SELECT series, abs(g - median(g) OVER (PARTITION BY series)) AS d FROM k) SELECT series, round_even(median(d), 9) AS mad_glucose FROM m GROUP BY series"
)
def cgm_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.absolute_deviation(_rows(spark, sf_dir, USERS), USERS))


@query(
    "cgm_grade",
    _base("event_type", "value > 18")
    + "SELECT series, round_even(avg(least(greatest(425e0 * pow(log10(log10(g / 18e0)) + 0.16e0, 2), 0e0), 50e0)), 9) AS grade FROM k GROUP BY series",
)
def cgm_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.per_series(_rows(spark, sf_dir, TYPES, F.col("value") > 18), TYPES, glucose.grade()))


_W = "(pi() / 12)"


@query(
    "cgm_cosinor",
    _base("event_type")
    + f""", x AS (SELECT series, g, cos({_W} * {_HOD}) AS c, sin({_W} * {_HOD}) AS s FROM k),
m AS (SELECT series, count(*) AS n, avg(g) AS mg, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS vc, var_pop(s) AS vs, covar_pop(c, s) AS cs, covar_pop(g, c) AS gc, covar_pop(g, s) AS gs FROM x GROUP BY series),
b AS (SELECT *, (gc * vs - gs * cs) / (vc * vs - cs * cs) AS bc, (gs * vc - gc * cs) / (vc * vs - cs * cs) AS bs FROM m WHERE n >= 24)
SELECT series, round_even(mg - bc * mc - bs * ms, 9) AS cosinor_mesor, round_even(sqrt(bc * bc + bs * bs), 9) AS cosinor_amplitude,
round_even((CASE WHEN atan2(bs, bc) < 0 THEN atan2(bs, bc) + 2 * pi() ELSE atan2(bs, bc) END) * 12 / pi(), 9) AS cosinor_acrophase_h FROM b""",
)
def cgm_cosinor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.per_series(_rows(spark, sf_dir, TYPES), TYPES, glucose.cosinor(TYPES)))


_DAYS = f""", y AS (SELECT series, t::DATE AS day, count(*) AS n, avg(g) AS mean, stddev_samp(g) AS sd, max(g) - min(g) AS span, sum(greatest(g - 180, 0e0)) AS hi, sum(greatest(70 - g, 0e0)) AS lo,
max({_LOW}) + max({_HIGH}) AS risk FROM k GROUP BY series, t::DATE) """


def _daily(name: str, sql: str, *columns: str) -> None:
    @query(name, _base("event_type") + _DAYS + f"SELECT series, {sql} FROM y GROUP BY series")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(glucose.daily(_rows(spark, sf_dir, TYPES), TYPES).select("series", *columns))


_daily("cgm_daily_range", "round_even(avg(span) FILTER (n >= 12), 9) AS mean_daily_range", "mean_daily_range")
_daily(
    "cgm_within_between_sd",
    "CASE WHEN count(*) FILTER (n >= 12) > 0 THEN round_even(avg(sd), 9) END AS within_day_sd, round_even(stddev_samp(mean) FILTER (n >= 12), 9) AS between_day_sd",
    "within_day_sd", "between_day_sd",
)
_daily("cgm_adrr", "round_even(avg(risk) FILTER (n >= 12), 9) AS adrr", "adrr")
_daily(
    "cgm_daily_auc",
    "round_even(avg(hi) FILTER (n >= 12), 9) AS hyper_auc_per_day, round_even(avg(lo) FILTER (n >= 12), 9) AS hypo_auc_per_day",
    "hyper_auc_per_day", "hypo_auc_per_day"
)


@query(
    "cgm_nightly_means",
    _base("user_id")
    + """, n AS (SELECT series, t::DATE AS night, avg(g) AS mean, sum(g) AS total, count(*) AS n FROM r WHERE hour(t) < 6 GROUP BY series, t::DATE)
SELECT series, round_even(sum(total) / sum(n), 9) AS pooled_mean, sum(n)::BIGINT AS n_readings, round_even(avg(mean), 9) AS mean_of_nightly_means, count(*) AS n_nights FROM n GROUP BY series""",
)
def cgm_nightly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.nightly(_rows(spark, sf_dir, USERS)))


@query("cgm_grid", _base("event_type") + _GRID + " SELECT series, slot, g FROM d")
def cgm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.grid(series.enough(_rows(spark, sf_dir, TYPES), TYPES), TYPES)


@query(
    "cgm_resample_mean",
    _base("event_type") + "SELECT series, floor(epoch(t) / 3600)::BIGINT AS slot, round_even(avg(g), 9) AS g FROM r GROUP BY ALL"
)
def cgm_resample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.clock_means(_rows(spark, sf_dir, TYPES), TYPES))


@query(
    "cgm_modd_resampled",
    _base("event_type")
    + """, c AS (SELECT series, floor(epoch(t) / 3600)::BIGINT AS slot, avg(g) AS g FROM r GROUP BY ALL),
j AS (SELECT a.series, b.g AS prev, abs(a.g - b.g) AS d FROM c a LEFT JOIN c b ON a.series = b.series AND a.slot = b.slot + 24)
SELECT series, CASE WHEN count(prev) >= 24 THEN round_even(avg(d), 9) END AS modd_resampled, count(prev) AS n_pairs FROM j GROUP BY series""",
)
def cgm_modd_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.resampled_modd(_rows(spark, sf_dir, TYPES), TYPES, min_pairs=24))


def _dynamics(name: str, body: str, *columns: str) -> None:
    @query(name, _base("event_type") + _GRID + body)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        slots = series.grid(series.enough(_rows(spark, sf_dir, TYPES), TYPES), TYPES)
        return rounded(glucose.grid_dynamics(slots, TYPES).select("series", *columns))


_LAG = ", l AS (SELECT a.series, a.g, b.g AS g1 FROM d a LEFT JOIN d b ON a.series = b.series AND a.slot = b.slot + {}) "
_dynamics("cgm_modd", _LAG.format(24) + "SELECT series, round_even(avg(abs(g - g1)), 9) AS modd FROM l GROUP BY series", "modd")
_dynamics(
    "cgm_conga",
    ", h AS (SELECT unnest([1, 2, 4, 6]) AS h), l AS (SELECT a.series, h, a.g - b.g AS d FROM h, d a JOIN d b ON a.series = b.series AND a.slot = b.slot + h) SELECT series, "
    + ", ".join(f"round_even(stddev_samp(d) FILTER (h = {h}), 9) AS conga{h}" for h in (1, 2, 4, 6))
    + " FROM l GROUP BY series",
    "conga1", "conga2", "conga4", "conga6",
)
_dynamics(
    "cgm_roc",
    _LAG.format(1)
    + """SELECT series, round_even(avg(abs(g - g1) / 60), 9) AS roc_mean_abs, round_even(stddev_samp((g - g1) / 60), 9) AS roc_sd,
round_even(avg(CASE WHEN (g - g1) / 60 > 2 THEN 100e0 ELSE 0e0 END) FILTER (g1 IS NOT NULL), 9) AS pct_rapid_rise,
round_even(avg(CASE WHEN (g - g1) / 60 < -2 THEN 100e0 ELSE 0e0 END) FILTER (g1 IS NOT NULL), 9) AS pct_rapid_fall FROM l GROUP BY series""",
    "roc_mean_abs", "roc_sd", "pct_rapid_rise", "pct_rapid_fall",
)
_dynamics(
    "cgm_mag",
    ", l AS (SELECT series, slot, abs(g - lag(g) OVER (PARTITION BY series ORDER BY slot)) AS d FROM d) SELECT series, round_even(sum(d) / nullif(max(slot) - min(slot), 0), 9) AS mag_per_hour FROM l GROUP BY series",
    "mag_per_hour",
)
_dynamics(
    "cgm_poincare",
    _LAG.format(1)
    + """, q AS (SELECT series, count(g1) AS n, stddev_samp((g - g1) / sqrt(2)) AS a, stddev_samp((g + g1) / sqrt(2)) AS b FROM l GROUP BY series)
SELECT series, CASE WHEN n >= 3 THEN round_even(a, 9) END AS poincare_sd1, CASE WHEN n >= 3 THEN round_even(b, 9) END AS poincare_sd2, CASE WHEN n >= 3 THEN round_even(a / nullif(b, 0), 9) END AS poincare_ratio FROM q""",
    "poincare_sd1", "poincare_sd2", "poincare_ratio",
)
_dynamics(
    "cgm_autocorr",
    _LAG.format(1) + "SELECT series, CASE WHEN count(g1) >= 3 THEN round_even(corr(g, g1), 9) END AS autocorr_lag1 FROM l GROUP BY series",
    "autocorr_lag1"
)


@query(
    "cgm_mage",
    _base("user_id")
    + """, w AS (SELECT series, t, tie, g, lag(g) OVER o AS a, lead(g) OVER o AS b, stddev_samp(g) OVER (PARTITION BY series) AS sd FROM k WINDOW o AS (PARTITION BY series ORDER BY t, tie)),
z AS (SELECT series, sd, abs(g - lag(g) OVER (PARTITION BY series ORDER BY t, tie)) AS amp FROM w WHERE a IS NULL OR b IS NULL OR (g > a AND g > b) OR (g < a AND g < b))
SELECT series, round_even(coalesce(avg(amp) FILTER (amp > sd), 0e0), 9) AS mage FROM z GROUP BY series HAVING max(sd) > 0""",
)
def cgm_mage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.excursions(_rows(spark, sf_dir, USERS), USERS))


@query(
    "cgm_mage_daily",
    _base("event_type")
    + """, y AS (SELECT *, t::DATE AS day, stddev_pop(g) OVER q AS sd, count(*) OVER q AS n, lag(g) OVER o AS a, lead(g) OVER o AS b FROM r
WINDOW q AS (PARTITION BY series, t::DATE), o AS (PARTITION BY series, t::DATE ORDER BY t, tie)),
z AS (SELECT series, day, sd, abs(g - lag(g) OVER (PARTITION BY series, day ORDER BY t, tie)) AS amp FROM y WHERE n >= 12 AND (a IS NULL OR b IS NULL OR (g > a AND g > b) OR (g < a AND g < b))),
v AS (SELECT series, day, avg(amp) FILTER (amp > sd) AS mage FROM z GROUP BY series, day)
SELECT series, round_even(avg(mage), 9) AS mage_daily, count(mage) AS n_days FROM v GROUP BY series""",
)
def cgm_mage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.excursions_by_day(_rows(spark, sf_dir, TYPES), min_day_readings=12))


@query(
    "cgm_episodes",
    _base("user_id")
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, tie) AS i FROM k),
f AS (SELECT series, kind, i - row_number() OVER (PARTITION BY series, kind ORDER BY i) AS run FROM (SELECT series, i, CASE WHEN g < 70 THEN 'hypo' WHEN g > 180 THEN 'hyper' END AS kind FROM n) WHERE kind IS NOT NULL),
e AS (SELECT series, kind, run, count(*) AS len FROM f GROUP BY ALL HAVING count(*) >= 3)
SELECT s.series, count(len) FILTER (kind = 'hypo') AS n_hypo_events, round_even(coalesce(avg(len * 5e0) FILTER (kind = 'hypo'), 0e0), 9) AS mean_hypo_dur_min,
count(len) FILTER (kind = 'hyper') AS n_hyper_events, round_even(coalesce(avg(len * 5e0) FILTER (kind = 'hyper'), 0e0), 9) AS mean_hyper_dur_min
FROM (SELECT DISTINCT series FROM k) s LEFT JOIN e USING (series) GROUP BY s.series""",
)
def cgm_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.episodes(_rows(spark, sf_dir, USERS), USERS))


_DFA = """, a AS (SELECT series, g - avg(g) OVER (PARTITION BY series) AS e, row_number() OVER (PARTITION BY series ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM d),
c AS (SELECT series, i, n, sum(e) OVER (PARTITION BY series ORDER BY i) AS y FROM a WHERE n >= 128), u AS (SELECT unnest([4, 8, 16, 32, 64]) AS s),
b AS (SELECT series, s, i // s AS v, var_pop(y) - pow(covar_pop(y, i % s), 2) / var_pop(i % s) AS q FROM c, u WHERE (i // s + 1) * s <= n GROUP BY series, s, i // s),
f AS (SELECT series, s, avg(sqrt(greatest(q, 0e0))) AS f FROM b GROUP BY series, s)
SELECT series, round_even(regr_slope(ln(f), ln(s)), 9) AS dfa_alpha FROM f WHERE f > 0 GROUP BY series HAVING count(*) >= 2"""


@query("cgm_dfa", _base("event_type") + _GRID + _DFA)
def cgm_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(glucose.fluctuation(series.grid(series.enough(_rows(spark, sf_dir, TYPES), TYPES), TYPES)).where("dfa_alpha IS NOT NULL"))


def _complexity(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return rounded(glucose.complexity(series.enough(_rows(spark, sf_dir, TYPES), TYPES), TYPES).select("series", *columns))


@query(
    "cgm_sample_entropy",
    _base("event_type")
    + _GRID
    + """, o AS (SELECT series, row_number() OVER w AS i, g, lead(g, 1) OVER w AS g1, lead(g, 2) OVER w AS g2, 0.2e0 * stddev_pop(g) OVER (PARTITION BY series) AS tol FROM d WINDOW w AS (PARTITION BY series ORDER BY slot)),
m AS (SELECT x.series, count(*) FILTER (abs(x.g - y.g) <= x.tol AND abs(x.g1 - y.g1) <= x.tol) AS b,
count(*) FILTER (abs(x.g - y.g) <= x.tol AND abs(x.g1 - y.g1) <= x.tol AND abs(x.g2 - y.g2) <= x.tol) AS a FROM o x JOIN o y ON x.series = y.series AND x.i <> y.i GROUP BY x.series)
SELECT s.series, CASE WHEN a > 0 AND b > 0 THEN round_even(-ln(a::DOUBLE / b), 9) END AS sample_entropy FROM (SELECT DISTINCT series FROM d) s LEFT JOIN m USING (series)""",
)
def cgm_sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complexity(spark, sf_dir, "sample_entropy")


@query(
    "cgm_spectral",
    _base("event_type")
    + _GRID
    + """, c AS (SELECT series, slot, slots, g - avg(g) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n FROM d),
f AS (SELECT DISTINCT series, slots, unnest(range(1, slots // 2 + 1)) AS k FROM c WHERE n >= 48),
q AS (SELECT f.series, f.k, f.slots, pow(sum(e * cos(2 * pi() * k * slot / f.slots)), 2) + pow(sum(e * sin(2 * pi() * k * slot / f.slots)), 2) AS power FROM f JOIN c USING (series) GROUP BY f.series, f.k, f.slots),
h AS (SELECT *, power / sum(power) OVER (PARTITION BY series) AS p, k / slots::DOUBLE AS freq FROM q)
SELECT s.series, round_even(sum(p) FILTER (freq >= 1 / 28e0 AND freq <= 1 / 20e0), 9) AS spectral_circadian_frac, round_even(1 / arg_max(freq, p), 9) AS spectral_dominant_period_h,
round_even(-sum(p * ln(p)) FILTER (p > 0) / ln(count(*) FILTER (p > 0)), 9) AS spectral_entropy FROM (SELECT DISTINCT series FROM d) s LEFT JOIN h USING (series) GROUP BY s.series""",
)
def cgm_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complexity(spark, sf_dir, "spectral_circadian_frac", "spectral_dominant_period_h", "spectral_entropy")


def _table_oracle() -> str:
    """The families' queries, by event type, joined on the series."""
    parts = [_raw_oracle(n, "event_type") for n in RAW]
    parts.append(
        _base("event_type")
        + """SELECT series, count(*) AS qc_n_egv, (max(epoch_us(t)) - min(epoch_us(t))) / 1e6 / 86400 AS qc_wear_span_days, count(DISTINCT t::DATE) AS qc_n_days,
100e0 * count(*) / ((max(epoch_us(t)) - min(epoch_us(t))) / 1e6 / 86400 * 24) AS qc_pct_active FROM k GROUP BY series"""
    )
    parts.append(
        _base("event_type") + ", m AS (SELECT series, abs(g - median(g) OVER (PARTITION BY series)) AS d FROM k) SELECT series, round_even(median(d), 9) AS mad_glucose FROM m GROUP BY series"
    )
    parts.append(
        _base("event_type") + "SELECT series, CASE WHEN min(g) >= 18 THEN avg(least(greatest(425e0 * pow(log10(log10(greatest(g, 18.0001e0) / 18e0)) + 0.16e0, 2), 0e0), 50e0)) END AS grade FROM k GROUP BY series"
    )
    shared = (
        "cosinor", "daily_range", "within_between_sd", "adrr", "daily_auc", "modd", "conga", "roc", "mag", "poincare", "autocorr",
        "dfa", "sample_entropy", "spectral"
    )
    parts += [ORACLES[f"cgm_{n}"] for n in shared]
    parts += [
        ORACLES[f"cgm_{n}"].replace(
            "SELECT user_id AS series", "SELECT event_type AS series"
        ).replace("5e0) FILTER", "60e0) FILTER") for n in ("mage", "episodes")
    ]
    cells = [f"round_even({c}, 9) AS {c}" if c in glucose.DIGITS else f"{c} AS {c}" for c in glucose.ORDER]
    joined = " LEFT JOIN ".join([f"({parts[0]}) q0"] + [f"({p}) q{i} USING (series)" for i, p in enumerate(parts) if i])
    return f"SELECT series, {', '.join(cells)} FROM {joined}"


@query("cgm_feature_table", _table_oracle())
def cgm_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In full digits: the published ones would round ties by the last bit of a sum."""
    return rounded(glucose.feature_table(_rows(spark, sf_dir, TYPES), TYPES, published=False))
