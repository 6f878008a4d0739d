"""Daily and weekly sensor summaries of every participant, kept current as new readings arrive.

    python -m jobs.sensor_summaries --source IN --readings STATE --output OUT --checkpoint CHECKPOINT

`source` is a folder of Parquet readings to which uploads are added, or a pattern of files and folders
(a file stream does not take the plain name of a file). A run takes the files
that are new since the last one, in batches, as a file stream until nothing is left; which files it
took is in the stream's checkpoint. A batch

1. writes its known readings to `readings`, under their day and the batch's number,
2. reads back the weeks it touched, of which it takes the partitions of these weeks only, keeps of each
   reading (series, time, event) what the latest batch says, and
3. writes the days and weeks of those in place of the former ones to `output`, under level and start.

So late readings and corrections change the days and weeks that they belong to, and nothing else is
read or written again. A batch that is stopped half-way is taken again by the next run under the
same number: it then writes the same partitions, and reruns give the same result. A lost checkpoint
only means that every file is read again.

Readings without series, time or finite value count as unknown and are left out. A week starts on
Monday. `active_pct` is the share of the readings that the sensor's cadence allows in the period.
"""

from __future__ import annotations

import datetime as dt
import logging
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobs.common import main, write
from tidewater.operators import glucose
from tidewater.operators.series import SeriesSpec, readings as known_readings

log = logging.getLogger("jobs.sensor_summaries")
DAYS = {"day": 1, "week": 7}
#: Days that a batch may span for its table of weeks to be broadcast.
BROADCAST_DAYS = 36_525


def features() -> dict[str, Column]:
    return {"n_readings": F.count("*")} | glucose.central() | glucose.percentiles() | glucose.time_in_range() | glucose.indices()


def week_of(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def summaries(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """level, start, series and features of readings (series, t, g), by day and by week."""
    day = F.to_date("t")
    periods = F.array(
        F.struct(F.lit("day").alias("level"), day.alias("start")),
        F.struct(F.lit("week").alias("level"), week_of(day).alias("start")),
    )
    each = rows.select("series", "t", "g", F.inline(periods)).groupBy("level", "start", "series").agg(*[c.alias(n) for n, c in features().items()])
    days = F.when(F.col("level") == "day", DAYS["day"]).otherwise(DAYS["week"])
    return each.withColumn("active_pct", 100.0 * F.col("n_readings") / (days * spec.per_day))


def latest(rows: DataFrame) -> DataFrame:
    """Each reading once, as its latest batch has it; of two in one batch, the larger value."""
    return rows.groupBy("series", "t", "tie").agg(F.max_by("g", F.struct("batch", "g")).alias("g"))


def _take(batch: DataFrame, number: int, paths: dict[str, str], spec: SeriesSpec, where: str | None) -> dict[str, Any]:
    day = F.to_date("t")
    rows = known_readings(batch, spec, F.expr(where) if where else None).withColumns({"day": day, "batch": F.lit(number).cast("long")})
    kept = write(rows, paths["readings"], ["day", "batch"]).withColumn("week", week_of(F.col("day")))
    # Counts of what is written come from the files' footers. Weeks of a batch are partition values:
    # one row each, and their ends prune the scan below.
    done = {"batch": number, "known": kept.where(F.col("batch") == number).count()}
    if not done["known"]:
        return done
    weeks = kept.where(F.col("batch") == number).select("week").distinct()
    first, last = weeks.agg(F.min("week"), F.max("week")).first()
    end = last + dt.timedelta(days=DAYS["week"] - 1)
    weeks = F.broadcast(weeks) if (last - first).days < BROADCAST_DAYS else weeks
    current = latest(kept.where(F.col("day").between(F.lit(first), F.lit(end))).join(weeks, "week", "left_semi"))
    written = write(summaries(current, spec), paths["output"], ["level", "start"]).where(F.col("start").between(F.lit(first), F.lit(end)))
    done["written"] = written.withColumn("week", week_of(F.col("start"))).join(weeks, "week", "left_semi").count()
    return done | {"from": first, "to": end}


def run(spark: SparkSession, source: str, readings: str, output: str, checkpoint: str, config: dict[str, Any]) -> dict[str, Any]:
    """Takes what is new in `source` and brings the days and weeks it touches up to date."""
    spec = SeriesSpec(config["key"], config["time"], config["value"], config["tie"], interval_min=config["interval_min"])
    stream = (
        spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    )
    batches: list[dict[str, Any]] = []

    def take(batch: DataFrame, number: int) -> None:
        batches.append(_take(batch, number, {"readings": readings, "output": output}, spec, config["where"]))
        log.info("%s", batches[-1])

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %s: %d batches, %d rows", source, len(batches), taken)
    return {"batches": len(batches), "read": taken, "known": sum(b["known"] for b in batches), "written": sum(b.get("written", 0) for b in batches)}


def result(spark: SparkSession, output: str) -> DataFrame:
    """The summaries as they stand."""
    return spark.read.parquet(output)


if __name__ == "__main__":
    main(
        "sensor_summaries",
        run,
        {
            "source": "Parquet readings, to which files are added",
            "readings": "the table of readings that the job keeps",
            "output": "the table of summaries",
            "checkpoint": "the stream's checkpoint",
        },
    )
