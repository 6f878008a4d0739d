"""Reading and writing: readings, wide tables, metadata, incremental results, the dictionary."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.operators.glucose import DIGITS, ORDER
from tidewater.operators.prep import merge_features


def read_readings(spark: SparkSession, path: str, columns: Sequence[str], kind: str = "event_type", keep: str = "EGV") -> DataFrame:
    """A Parquet table of readings: only these columns, only rows of the kind, none unknown. The
    filter and the columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col(kind) == keep)
    return rows.select(*columns).na.drop(subset=list(columns))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, index: bool = False) -> DataFrame:
    """A CSV table with a header; a first column without a name is the key `index`."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    if index:
        df = df.withColumnRenamed(df.columns[0], "index")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_results(df: DataFrame, path: str, by: str = "study_group") -> None:
    """Add a group's results to a partitioned table, so a stopped run keeps what it has; a group that
    is written again takes the place of its former results."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_features(spark: SparkSession, base: str, features: DataFrame, key: str, target: str, legacy: Sequence[str] = ()) -> DataFrame:
    """The table at `base` with new features in place of old ones, written to another path, as a
    table cannot be overwritten while it is read."""
    if base.rstrip("/") == target.rstrip("/"):
        raise ValueError("the merged table needs a path of its own")
    merge_features(spark.read.parquet(base), features, key, legacy).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def load_meta(spark: SparkSession, path: str) -> dict[str, Any]:
    """One small JSON document by any path Spark reads; empty if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()) or "{}")


def save_meta(spark: SparkSession, path: str, **entries: Any) -> dict[str, Any]:
    """Merge entries into the JSON document and write it."""
    merged = load_meta(spark, path) | entries
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(json.dumps(merged, sort_keys=True, indent=1).encode()))
    finally:
        out.close()
    return merged


UNITS = {"pct": "%", "min": "min", "h": "h", "days": "days"}
# Features in mg/dL whose names do not say so (fixed values).
_GLUCOSE = "mage modd conga1 conga2 conga4 conga6 mean_daily_range within_day_sd between_day_sd poincare_sd1 poincare_sd2 cosinor_mesor cosinor_amplitude overnight_mean daytime_mean dawn_rise".split()


def unit_of(column: str) -> str:
    """The unit a feature's name stands for; empty where it has none."""
    if column.endswith("_glucose") or column in _GLUCOSE:
        return "mg/dL"
    if column.startswith("roc_"):
        return "mg/dL/min"
    return "mg/dL/h" if column == "mag_per_hour" else UNITS.get(column.rsplit("_", 1)[-1], "count" if column.startswith(("n_", "qc_n")) else "")


def dictionary(spark: SparkSession) -> DataFrame:
    """The feature table's columns, in order, with their published digits, and units by name."""
    return spark.createDataFrame(
        [(i + 1, c, DIGITS.get(c), unit_of(c)) for i, c in enumerate(ORDER)], "place int, column string, digits int, unit string"
    )


def report(df: DataFrame, template: str) -> list[str]:
    """Lines of a small summary table, in the table's order, by a format string over its columns."""
    return [template.format(**r.asDict()) for r in df.collect()]


def synthetic_readings(spark: SparkSession, days: int = 10, subjects: int = 1, interval_min: int = 5, seed: int = 0) -> DataFrame:
    """Series with a circadian wave, three meals and noise, clipped to 40-400, a twentieth missing."""
    per_day = 1440 // interval_min
    slot = F.col("id") % (days * per_day)
    subject = F.floor(F.col("id") / (days * per_day))
    hour = slot * interval_min / 60.0 % 24
    # The wave's mean, swing and zero, and the meals' heights, hours and widths.
    wave = 120 + 30 * F.sin((hour - 6) * (3.141592653589793 / 12))
    meals = sum((a * F.exp(-F.pow(hour - h, F.lit(2.0)) / w) for a, h, w in ((40.0, 8.0, 2.0), (45.0, 13.0, 2.0), (50.0, 19.0, 1.5))), F.lit(0.0))
    value = F.least(F.greatest(wave + meals + 8 * F.randn(seed), F.lit(40.0)), F.lit(400.0))
    at = F.timestamp_add("MINUTE", slot * interval_min, F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = spark.range(subjects * days * per_day).select(
        subject.alias("participant_id"), at.alias("t"), value.alias("glucose"), F.rand(seed + 1).alias("_u"),
        F.col("id").alias("reading")
    )
    return rows.where("_u > 0.05").drop("_u")
