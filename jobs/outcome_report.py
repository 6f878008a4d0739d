"""Which measures tell two outcomes apart, group by group: sizes, quartiles, rank tests and AUROC.

    python -m jobs.outcome_report --records DOCUMENTS --outcomes LABELS --output OUT

`records` has one row a participant (or document) with a key, a group and whatever the measures are
computed from; `outcomes` has the key and a 0/1 outcome. The measures are SQL expressions in the
settings. They are computed in the scan of the records, so that only numbers meet the outcomes. Rows
under the quality gate are left out and counted. For every group and measure the report has the
number, quartiles and rank test of both classes, and the Bonferroni bound over all tests that are
possible. It is written by group, in place of the former report of that group.

Unknown groups are the group ''; a row without outcome, and a measure without a value, take no part;
a group with one class only has sizes and quartiles and no test.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import main, write
from tidewater.operators import prep, statistics

log = logging.getLogger("jobs.outcome_report")
#: The report's columns; named, as a reader takes the names of partitions for numbers where it can.
COLUMNS = (
    "measure string, n_1 long, n_0 long, p25_1 double, median_1 double, p75_1 double, p25_0 double, median_0 double, p75_0 double, "
    "u_statistic double, z double, auroc double, p_value double, p_value_bonferroni double, n_excluded long, group string"
)


def measured(records: DataFrame, config: dict[str, Any]) -> DataFrame:
    """key, group and the measures, as doubles; nothing else is kept of a row."""
    group = F.coalesce(F.col(config["group"]).cast("string"), F.lit("")).alias("group")
    columns = [F.expr(e).cast("double").alias(n) for n, e in config["measures"].items()]
    return records.select(F.col(config["key"]).alias("key"), group, *columns)


def report(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """group, measure, n_excluded, and what `statistics.outcome_comparison` has of them; rows: key,
    group, outcome and measures."""
    names = list(config["measures"])
    good = prep.quality_gate(rows, config["gate"], config["floor"], keep_unknown=False)
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])
    long = good.select("group", "outcome", F.inline(cells))
    under = ~F.coalesce(F.col(config["gate"]) >= config["floor"], F.lit(False))
    excluded = rows.groupBy("group").agg(F.count_if(under).alias("n_excluded"))
    compared = statistics.outcome_comparison(long, ["group", "measure"], "value", "outcome")
    return compared.join(excluded, "group")


def run(spark: SparkSession, records: str, outcomes: str, output: str, config: dict[str, Any]) -> dict[str, Any]:
    """Writes the report of all groups to `output`, by group."""
    rows, known = spark.read.parquet(records), spark.read.parquet(outcomes)
    key, outcome = F.col(config["key"]).alias("key"), F.col(config["outcome"]).cast("double").alias("outcome")
    joined = statistics.once(measured(rows, config).join(known.select(key, outcome).where("outcome IS NOT NULL"), "key"))
    # Counts of whole tables come from the files' footers.
    done = {"records": rows.count(), "outcomes": known.count(), "labelled": joined.count()}
    log.info("read %s: %s rows; %s: %s rows; %s have both", records, done["records"], outcomes, done["outcomes"], done["labelled"])
    done["written"] = write(report(joined, config), output, ["group"]).count()
    log.info("wrote %s: it has %s rows", output, done["written"])
    return done


def result(spark: SparkSession, output: str) -> DataFrame:
    """The report as it stands. A partition without a name is the group ''."""
    return spark.read.schema(COLUMNS).parquet(output).withColumn("group", F.coalesce("group", F.lit("")))


if __name__ == "__main__":
    main("outcome_report", run, {"records": "Parquet rows to measure", "outcomes": "Parquet keys and outcomes", "output": "the report"})
