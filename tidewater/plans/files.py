"""Queries of readers, sinks and the dictionary: what is written and read back equals its source."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators import glucose, series
from tidewater.operators.glucose import ORDER
from tidewater.plans.cohort import COHORT, cohort
from tidewater.plans.registry import ORACLES, query, rounded, table
from tidewater.plans.series import RAW, USERS
from tidewater.sources import io
from tidewater.sources.shared import shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "read_readings",
    "SELECT user_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL"
)
def read_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return io.read_readings(spark, f"{sf_dir}/events.parquet", ["user_id", "ts", "value"], keep=kind)


@query("csv_round_trip", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns go to a CSV folder, three are read."""
    io.write_csv(table(spark, sf_dir, "customer"), path := _path(spark, "csv"))
    return io.read_csv(spark, path, ["c_custkey", "c_mktsegment", "c_acctbal"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("csv_with_index", "SELECT n_nationkey::BIGINT AS index, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def csv_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column has no name: it is the key."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_c0"), "n_name", "n_regionkey")
    io.write_csv(rows, path := _path(spark, "csv"))
    return io.read_csv(spark, path, index=True).withColumns({c: F.col(c).cast("long") for c in ("index", "n_regionkey")})


@query(
    "metadata_merge",
    COHORT + """SELECT 'best' AS name, '{"group": "' || min(study_group) || '"}' AS value FROM cohort UNION ALL SELECT 'rows', count(*)::VARCHAR FROM cohort UNION ALL SELECT 'stage', '"second"' """
)
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later entries take the place of former ones, others stay; what is kept is counted in the cohort."""
    path = _path(spark, "meta")
    found = cohort(spark, sf_dir).agg(F.count("*").alias("n"), F.min("study_group").alias("g")).first()
    io.save_meta(spark, path, stage="first", rows=found["n"])
    io.save_meta(spark, path, stage="second", best={"group": found["g"]})
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in io.load_meta(spark, path).items()], "name string, value string")


@query("results_written_again", COHORT + "SELECT study_group, count(*) AS n, round_even(avg(lab_a), 6) AS mean FROM cohort GROUP BY study_group")
def results_written_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups are appended one after another, the first one twice: it counts once."""
    rows = cohort(spark, sf_dir).groupBy("study_group").agg(F.count("*").alias("n"), F.avg("lab_a").alias("mean"))
    path, groups = _path(spark, "results"), sorted(r["study_group"] for r in rows.select("study_group").collect())
    for g in [*groups, groups[0]]:
        io.append_results(rows.where(F.col("study_group") == g), path)
    return rounded(spark.read.parquet(path).select("study_group", "n", "mean"), 6)


@query(
    "report_lines",
    COHORT + "SELECT 'group ' || study_group || ': ' || count(*) || ' participants, ' || count(lab_u) || ' with urgent orders' AS line FROM cohort GROUP BY study_group"
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).groupBy("study_group").agg(F.count("*").alias("n"), F.count("lab_u").alias("k"))
    return spark.createDataFrame([(x,) for x in io.report(rows, "group {study_group}: {n} participants, {k} with urgent orders")], "line string")


FAMILIES = ("cgm_central", "cgm_percentiles", "cgm_time_in_range", "cgm_gmi_jindex", "cgm_mvalue", "cgm_risk_lbgi_hbgi", "cgm_gri")


def _dictionary_sql() -> str:
    """Features, in the published order, with units by name and how many users have them."""
    parts = [
        f"SELECT feature, value FROM (UNPIVOT (SELECT * EXCLUDE (series) FROM ({ORACLES[f]})) ON COLUMNS(*) INTO NAME feature VALUE value)" for f in FAMILIES
    ]
    order = ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(ORDER))
    return f"""SELECT place, name AS "column", CASE WHEN name LIKE '%\\_glucose' ESCAPE '\\' THEN 'mg/dL' WHEN ends_with(name, '_pct') THEN '%' ELSE '' END AS unit, count(*) AS n_known
FROM (VALUES {order}) AS t(place, name) JOIN ({' UNION ALL '.join(parts)}) ON feature = name GROUP BY ALL"""


@query("feature_dictionary", _dictionary_sql())
def feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's entries of the raw families, with how many users have the feature."""
    families = {n: c for f in FAMILIES for n, c in RAW[f][0]().items()}
    rows = glucose.per_series(series.readings(table(spark, sf_dir, "events"), USERS), USERS, families)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n_known")) for c in families])
    known = rows.agg(cells.alias("cells")).select(F.inline("cells")).where("n_known > 0")
    return io.dictionary(spark).join(F.broadcast(known), "column").select("place", "column", "unit", "n_known")
