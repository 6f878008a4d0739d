"""Scalar expressions that NumPy-style statistics need, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int = 6) -> Column:
    """Rounding of the published contract: half to even."""
    return F.bround(x.cast("double"), digits)


def finite(x: Column) -> Column:
    """NaN and infinities become null, which aggregates skip."""
    value = x.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, as least and greatest would not leave it."""
    if low is not None:
        x = F.when(x < low, F.lit(float(low))).otherwise(x)
    if high is not None:
        x = F.when(x > high, F.lit(float(high))).otherwise(x)
    return x


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(condition: Column) -> Column:
    """Share of rows, in per cent, of those where the condition is known."""
    return F.avg(F.when(condition, 100.0).when(~condition, 0.0))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def hour_of_day(t: Column) -> Column:
    """Hours with minutes; seconds do not count."""
    return F.hour(t) + F.minute(t) / 60.0


def bins(x: Column, cuts: list[float], labels: list[str]) -> Column:
    """Left-closed bins: below cuts[0], then [cuts[i], cuts[i + 1]), then from the last on."""
    whens = zip(cuts, labels[:-1])
    chain = reduce(lambda c, w: c.when(x < w[0], w[1]), whens, F.when(x.isNull(), None))
    return chain.otherwise(labels[-1])


def first_of(flags: dict[str, Column]) -> Column:
    """Name of the greatest flag; ties go to the first, null if none is known."""
    top = F.greatest(*flags.values()) if len(flags) > 1 else next(iter(flags.values()))
    return reduce(lambda c, n: c.when(flags[n] == top, n), list(flags)[1:], F.when(flags[next(iter(flags))] == top, next(iter(flags))))


def low_risk(g: Column) -> tuple[Column, Column]:
    """Low and high blood-glucose risk of a reading clipped to 20-600 mg/dL."""
    f = 1.509 * (F.pow(F.ln(clip(g, 20, 600)), F.lit(1.084)) - 5.381)
    risk = 10 * f * f
    return F.when(f < 0, risk).otherwise(0.0), F.when(f > 0, risk).otherwise(0.0)
