"""The jobs as queries over the test tables: each runs twice into one new folder, and what stands
there after the second run is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs import outcome_report, sensor_summaries
from jobs.common import settings
from tidewater.plans.fits import NORMAL_P
from tidewater.plans.registry import rounded
from tidewater.plans.series import RAW
from tidewater.sources.shared import shared_dir


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_sensor_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and weekly summaries of all events; the second run finds nothing new. The table may be a
    file or a folder: the pattern takes both."""
    folder = _folder(spark, "job1")
    for _ in range(2):
        sensor_summaries.run(
            spark, f"{sf_dir}/events.parque[t]", f"{folder}/readings", f"{folder}/summaries", f"{folder}/checkpoint", settings("sensor_summaries")
        )
    return rounded(sensor_summaries.result(spark, f"{folder}/summaries").withColumn("start", F.col("start").cast("string")))


def job2_outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of texts against the toxic label, by language."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        outcome_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/report", settings("outcome_report"))
    return rounded(outcome_report.result(spark, f"{folder}/report"))


_FEATURES = {n: e for family in ("cgm_central", "cgm_percentiles", "cgm_time_in_range", "cgm_gmi_jindex") for n, e in RAW[family][1].items()}
SUMMARIES_SQL = f"""
WITH r AS (SELECT user_id AS series, ts AS t, event_id AS tie, max(value) AS g FROM events
  WHERE value IS NOT NULL AND isfinite(value) AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
e AS (SELECT 'day' AS level, t::DATE AS start, 1 AS days, series, g FROM r
  UNION ALL SELECT 'week', date_trunc('week', t)::DATE, 7, series, g FROM r)
SELECT level, start::VARCHAR AS start, series, count(*) AS n_readings, {", ".join(f"round_even({e}, 9) AS {n}" for n, e in _FEATURES.items())},
  round_even(100e0 * count(*) / (any_value(days) * 288), 9) AS active_pct
FROM e GROUP BY level, start, series
"""

_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_HITS = "len(regexp_extract_all(text, '{}'))"
_WORDS = f"nullif({_HITS.format(_WORD)}, 0)"
_MEASURES = {
    "n_chars": "length(text)",
    "n_words": _HITS.format(_WORD),
    "mean_word_length": f"{_HITS.format(_SPACE)}::DOUBLE / {_WORDS}",
    "digit_pct": f"100e0 * {_HITS.format('[0-9]')} / nullif(length(text), 0)",
    "capital_pct": f"100e0 * {_HITS.format('[A-Z]')} / nullif(length(text), 0)",
    "stops_per_100_words": f"100e0 * {_HITS.format('[.!?]')} / {_WORDS}",
    "distinct_pct": f"100e0 * len(list_distinct(regexp_extract_all(text, '{_WORD}'))) / {_WORDS}",
}
_QUARTILES = ", ".join(
    f"round_even(quantile_cont(v, {p}) FILTER (y {test} 0), 9) AS {name}_{c}"
    for c, test in (("1", ">"), ("0", "<="))
    for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))
)
REPORT_SQL = f"""
WITH m AS (SELECT coalesce(lang, '') AS "group", toxic AS y, {", ".join(f"({e})::DOUBLE AS {n}" for n, e in _MEASURES.items())}
  FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
x AS (SELECT "group", count(*) FILTER (n_words IS NULL OR n_words < 5) AS n_excluded FROM m GROUP BY ALL),
l AS (UNPIVOT (SELECT * FROM m WHERE n_words >= 5) ON {", ".join(_MEASURES)} INTO NAME measure VALUE v),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY "group", measure, v) - 1) / 2e0 AS k
  FROM l WINDOW w AS (PARTITION BY "group", measure ORDER BY v)),
t AS (SELECT "group", measure, sum(c * c * c - c) AS ties FROM (SELECT "group", measure, v, count(*)::DOUBLE AS c FROM l GROUP BY ALL) GROUP BY ALL),
s AS (SELECT "group", measure, count(*) FILTER (y > 0) AS n_1, count(*) FILTER (y <= 0) AS n_0, sum(k) FILTER (y > 0) AS k, {_QUARTILES}
  FROM r GROUP BY ALL),
u AS (SELECT *, CASE WHEN n_1 > 0 AND n_0 > 0 THEN k - n_1 * (n_1 + 1) / 2e0 END AS u, (n_1 + n_0)::DOUBLE AS n, n_1 * n_0::DOUBLE AS b
  FROM s JOIN t USING ("group", measure) JOIN x USING ("group")),
z AS (SELECT *, CASE WHEN u IS NOT NULL THEN greatest(abs(u - b / 2) - 0.5, 0) END / nullif(sqrt(b / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z, count(u) OVER () AS tests FROM u)
SELECT "group", measure, n_excluded, n_1, n_0, p25_1, median_1, p75_1, p25_0, median_0, p75_0, u AS u_statistic, round_even(z, 9) AS z,
  round_even(u / nullif(b, 0), 9) AS auroc, CASE WHEN z IS NOT NULL THEN round_even({NORMAL_P.format(z="z")}, 9) END AS p_value,
  CASE WHEN z IS NOT NULL THEN round_even(least(1, {NORMAL_P.format(z="z")} * tests), 9) END AS p_value_bonferroni
FROM z
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "job1_sensor_summaries": job1_sensor_summaries,
    "job2_outcome_report": job2_outcome_report,
}
ORACLES = {"job1_sensor_summaries": SUMMARIES_SQL, "job2_outcome_report": REPORT_SQL}
