"""Sensor series: readings of many subjects, snapped to grids, lagged and cut into runs.

A series key is a subject (or a sensor of one), whose readings are bounded by time, so windows over
a key fit a task; all families below share the one shuffle by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidewater.functions.numeric import finite, seconds_between


@dataclass(frozen=True)
class SeriesSpec:
    """Columns of a readings table, and the sensor's cadence."""

    key: str
    time: str
    value: str
    tie: str
    interval_min: int = 5
    min_readings: int = 48
    min_day_readings: int = 12

    @property
    def per_day(self) -> int:
        return 1440 // self.interval_min


def by_time() -> WindowSpec:
    return Window.partitionBy("series").orderBy("t", "tie")


def by_slot() -> WindowSpec:
    return Window.partitionBy("series").orderBy("slot")


def readings(df: DataFrame, spec: SeriesSpec, where: Column | None = None) -> DataFrame:
    """series, t, tie, g: known readings only; NaN and infinities count as unknown."""
    rows = df.where(where) if where is not None else df
    named = rows.select(
        F.col(spec.key).alias("series"), F.col(spec.time).alias("t"), F.col(spec.tie).alias("tie"),
        finite(F.col(spec.value)).alias("g")
    )
    return named.where("series IS NOT NULL AND t IS NOT NULL AND g IS NOT NULL")


def enough(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows of the series that have min_readings readings or more."""
    n = F.count("*").over(Window.partitionBy("series"))
    return rows.withColumn("_n", n).where(F.col("_n") >= spec.min_readings).drop("_n")


def grid(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """series, slot, g: readings snapped to the nearest slot (half to even) of a grid from the first
    one on; the last reading of a slot wins, and one that rounds past the end is dropped."""
    all_ = Window.partitionBy("series")
    step = spec.interval_min * 60
    first, last = F.min("t").over(all_), F.max("t").over(all_)
    placed = rows.select(
        "series",
        "t",
        "tie",
        "g",
        F.bround(seconds_between(first, F.col("t")) / step).cast("long").alias("slot"),
        (F.floor(seconds_between(first, last) / step) + 1).alias("slots"),
    )
    return placed.where("slot < slots").groupBy("series", "slot").agg(F.max_by("g", F.struct("t", "tie")).alias("g"))


def clock_means(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """series, slot, g: means by clock interval since the epoch; collisions are averaged."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    slot = F.floor(F.timestamp_diff("SECOND", epoch, F.col("t").cast("timestamp_ntz")) / (spec.interval_min * 60))
    return rows.groupBy("series", slot.alias("slot")).agg(F.avg("g").alias("g"))


def lagged(slots: DataFrame, lags: dict[str, int]) -> DataFrame:
    """The grid with, for each name, the value exactly `lag` slots before, null where there is a
    gap: a frame of one slot, so one sort serves all lags and no row is joined."""
    return slots.withColumns({name: F.max("g").over(by_slot().rangeBetween(-lag, -lag)) for name, lag in lags.items()})


def turning_points(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows where the series turns, with its end points; equal neighbours do not turn."""
    w = Window.partitionBy(*by).orderBy("t", "tie")
    before, after = F.lag("g").over(w), F.lead("g").over(w)
    turns = (F.col("g") - before) * (after - F.col("g")) < 0
    return rows.withColumn("_turn", before.isNull() | after.isNull() | turns).where("_turn").drop("_turn")


def runs(rows: DataFrame, flag: Column, order: list[str] | None = None) -> DataFrame:
    """series, run, length: maximal runs of consecutive rows where the flag holds."""
    keys = order or ["t", "tie"]
    w = Window.partitionBy("series").orderBy(*keys)
    flagged = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_row", F.row_number().over(w))
    held = Window.partitionBy("series", "_flag").orderBy(*keys)
    island = flagged.withColumn("run", F.col("_row") - F.row_number().over(held)).where("_flag")
    return island.groupBy("series", "run").agg(F.count("*").alias("length"))
