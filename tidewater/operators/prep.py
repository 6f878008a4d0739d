"""Relational preparation of wide participant tables: gates, imputation, codes, scaling, joins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.numeric import bins, finite, first_of
from tidewater.operators.statistics import average_ranks

BMI = ([18.5, 25.0, 30.0], ["underweight", "healthy", "overweight", "obese"])
HBA1C = ([5.7, 6.5], ["normal", "prediabetes", "diabetes"])


def quality_gate(df: DataFrame, column: str, floor: float = 70, keep_unknown: bool = True) -> DataFrame:
    """Rows of enough quality; unknown quality passes or fails by mode."""
    good = F.col(column) >= floor
    return df.where(good | F.col(column).isNull() if keep_unknown else good)


def excluded(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of `before` whose key is not in `after`."""
    return before.join(after.select(key), key, "left_anti")


def impute_by_group(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Unknown values become the median of their group's known ones; the medians are one row a
    group, computed once for all columns."""
    medians = df.groupBy(F.col(group).alias("_group")).agg(*[F.median(finite(F.col(c))).alias(f"_m_{c}") for c in columns])
    joined = df.join(medians, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"_m_{c}")) for c in columns}).drop("_group", *[f"_m_{c}" for c in columns])


def bmi_class(x: Column) -> Column:
    return bins(x, *BMI)


def hba1c_class(x: Column) -> Column:
    return bins(x, *HBA1C)


def merge_categories(x: Column, merged: Sequence[str], into: str) -> Column:
    return F.when(x.isin(*merged), into).otherwise(x)


def renamed_values(x: Column, names: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.when(x == kv[0], kv[1]).otherwise(c), names.items(), x)


def collapse_one_hot(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """The category whose flag is greatest, without the prefix; ties go to the first column."""
    flags = {c.removeprefix(prefix): F.col(f"`{c}`") for c in df.columns if c.startswith(prefix)}
    return df.withColumn(name, first_of(flags))


def dummies(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns of all categories but the first in sorted order."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in sorted(categories)[1:]})


def strata(df: DataFrame, group: str, **parts: str) -> DataFrame:
    """Composite keys `strata_<name>` of columns with the group; unknown parts read `nan`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return df.withColumns({f"strata_{n}": F.concat_ws("_", text(c), text(group)) for n, c in parts.items()})


def statistics(df: DataFrame, columns: Sequence[str], population: bool = True) -> dict[str, tuple[float | None, float | None]]:
    """Mean and SD of columns: one row, fetched, so that scaling is a narrow expression."""
    sd = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[f(finite(F.col(f"`{c}`"))).alias(f"{i}{k}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", sd))]).first()
    return {c: (row[f"{i}m"], row[f"{i}s"]) for i, c in enumerate(columns)}


def standardise(df: DataFrame, columns: Sequence[str], population: bool = True, suffix: str = "_z", learn: Column | str | None = None) -> DataFrame:
    """Columns less their mean, over their SD, of the rows to learn from (all by default); 0 where the
    SD is 0."""
    known = statistics(df if learn is None else df.where(learn), columns, population)
    z = lambda c: F.lit(None).cast("double") if known[c][0] is None else (finite(F.col(f"`{c}`")) - known[c][0]) / (known[c][1] or 1.0)
    return df.withColumns({f"{c}{suffix}": z(c) for c in columns})


def quantile_label(df: DataFrame, value: str, q: float, learn: Column, name: str = "label") -> DataFrame:
    """1 for values from the quantile of the learning rows on."""
    cut = df.where(learn).agg(F.percentile(value, q).alias("c")).first()["c"]
    return df.withColumn(name, (F.col(value) >= (cut if cut is not None else float("nan"))).cast("int"))


def split_of(key: Column, parts: int = 5) -> Column:
    """A fifth of the rows, by key, for testing."""
    return F.when(F.pmod(key, F.lit(parts)) == 0, "test").otherwise("train")


def split_by_stratum(df: DataFrame, key: str, stratum: str, share: float = 0.2, seed: int = 0, name: str = "split") -> DataFrame:
    """A test share of every stratum, rounded half up, in order of a hash of the key. Ranks come from
    ranges of hash values side by side, so a large stratum is not one task's."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double")
    ranked = average_ranks(df.withColumn("_h", h), "_h", [stratum], "_rank")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    held = ranked.join(sizes, F.col(stratum) == F.col("_s"))
    return held.withColumn(
        name, F.when(F.col("_rank") <= F.floor(F.col("_n") * share + 0.5), "test").otherwise("train")
    ).drop("_h", "_rank", "_s", "_n")


def join_suffixed(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two tables on a key; columns that both have get the suffixes."""
    shared = (set(a.columns) & set(b.columns)) - {key}
    left, right = (t.select(*[F.col(c).alias(c + x if c in shared else c) for c in t.columns]) for t, x in zip((a, b), suffixes))
    return left.join(right, key)


def merge_features(base: DataFrame, features: DataFrame, key: str, replaced: Sequence[str] = ()) -> DataFrame:
    """The base with new feature columns in place of any it had under these or `replaced` names."""
    new = [c for c in features.columns if c != key]
    return base.drop(*[c for c in base.columns if c in set(new) | set(replaced)]).join(features, key, "left")


class IntegrityError(ValueError):
    pass


def join_assignments(base: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Left join that fails if a row of the base has no assignment."""
    missing = base.join(assignments.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise IntegrityError(f"rows without an assignment under {key}")
    return base.join(assignments, key)


def snake_case(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns under plain names, cut to 50 characters and made unique, and the map to old ones."""
    names: dict[str, str] = {}
    for c in df.columns:
        base = re.sub(r"[^0-9a-z]+", "_", c.lower()).strip("_")[:50] or "column"
        name, n = base, 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names[name] = c
    return df.toDF(*names), names


def elapsed_days(df: DataFrame, key: str, time: str, start: float, end: float) -> DataFrame:
    """Rows from `start` to before `end` days after their key's first."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(time).alias("_first"))
    days = F.timestamp_diff("MICROSECOND", F.col("_first"), F.col(time)) / 86400e6
    joined = df.join(first, F.col(key) == F.col("_key")).withColumn("elapsed_days", days)
    return joined.where((F.col("elapsed_days") >= start) & (F.col("elapsed_days") < end)).drop("_key", "_first")


def usable_features(columns: Sequence[str], admin: Sequence[str], target: str) -> list[str]:
    """A feature list without identifiers, split and group columns and the target."""
    return [c for c in columns if c not in set(admin) | {target}]
