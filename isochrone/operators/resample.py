"""Frequency changes. Catalogue resampling labels period ends, evaluation labels period starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.frequency import FREQUENCY_RANK, check_frequency
from ..functions.spark import require_none
from .panel import asof_ffill, in_range
from .series import with_windows


def _per_period(df: DataFrame, label: Column, agg: Column, value: str, scope: list[str]) -> DataFrame:
    return df.groupBy(*scope, "asset", label.alias("ts")).agg(agg.alias(value))


def _all_periods(
    periods: DataFrame, frequency: str, value: str, scope: list[str], label: str = "start", end=None, carry: bool = False
) -> DataFrame:
    """Every period between a series' first and last (or ``end``); holes come back as missing, or
    with the value before them when ``carry``.

    Each row fills the hole up to the next row of its series, so the grid needs no join.
    """
    keys = [*scope, "asset"]
    last = None if end is None else F.date_add(D.period_end(F.lit(end).cast("date"), frequency), 1)

    def build(w):
        new = {"_next": F.lead("ts", 1).over(w)}
        if carry:
            new[value] = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return new

    ahead = with_windows(periods.select(*keys, "ts", value), keys, build, after=1)
    until = F.greatest(F.coalesce("_next", F.col("ts") if last is None else last), F.col("ts"))
    labels = F.filter(D.period_sequence(F.col("ts"), until, frequency, label), lambda d: (d == F.col("ts")) | (d < until))
    grown = ahead.withColumn("_label", F.explode(labels))
    if end is not None:
        grown = grown.filter(F.col("_label") <= F.lit(end).cast("date"))
    held = F.col(value) if carry else F.when(F.col("_label") == F.col("ts"), F.col(value))
    return grown.select(*keys, F.col("_label").alias("ts"), held.alias(value))


def resample_last(
    df: DataFrame, frequency: str, start=None, end=None, value: str = "value", scope: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """Fine to coarse: last present value per period, empty periods dropped.

    With ``end`` the result is put on the period labels up to ``end``: a later label is dropped, a
    hole inside is missing. ``strict`` refuses a ``start`` before the first row of a series.
    """
    scope = scope or []
    if strict and start is not None:
        late = df.groupBy(*scope, "asset").agg(F.min("ts").alias("first_row")).filter(F.col("first_row") > F.lit(start).cast("date"))
        require_none(late, "source does not cover the requested start")
    present = df.filter(F.col(value).isNotNull())
    periods = _per_period(present, D.period_end(F.col("ts"), frequency), F.max_by(value, "ts"), value, scope)
    return periods if end is None else _all_periods(periods, frequency, value, scope, "end", end)


def resample_sum_returns(df: DataFrame, frequency: str, value: str = "value", scope: list[str] | None = None) -> DataFrame:
    """Log returns summed per period; a period without any value is missing."""
    scope = scope or []
    if check_frequency(frequency) == "daily":
        return df
    periods = _per_period(df, D.period_start(F.col("ts"), frequency), F.sum(value), value, scope)
    return _all_periods(periods, frequency, value, scope)


def resample_first_nonzero(df: DataFrame, frequency: str, value: str = "value", scope: list[str] | None = None) -> DataFrame:
    """First non-zero value of the period; without one, the previous period's value is kept."""
    scope = scope or []
    if check_frequency(frequency) == "daily":
        return df
    first = F.min_by(F.col(value), F.when(F.col(value) != 0, F.col("ts")))
    periods = _per_period(df, D.period_start(F.col("ts"), frequency), first, value, scope)
    return _all_periods(periods, frequency, value, scope, carry=True)


def monthly_close_lagged(df: DataFrame, value: str = "value", scope: list[str] | None = None) -> DataFrame:
    """Month-end close that knows only the row before: lag one row, then last of month."""
    scope = scope or []
    lagged = with_windows(df, [*scope, "asset"], lambda w: {value: F.lag(value, 1).over(w)}, before=1)
    label = D.period_end(F.col("ts"), "monthly")
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("ts")))
    return _all_periods(_per_period(lagged, label, last, value, scope), "monthly", value, scope, "end")


def get_variable(df: DataFrame, native: str, target: str | None, start, end, value: str = "value") -> DataFrame:
    """Read a variable at a frequency: native rows in range, aggregated to a coarser one or carried
    onto a finer one (the load window is then widened by one print)."""
    target = target or native
    if target == native:
        return in_range(df, start, end)
    if FREQUENCY_RANK[target] > FREQUENCY_RANK[native]:
        return resample_last(in_range(df, start, end), target, start, end, value)
    widened = df.filter(
        (F.col("ts") >= D.one_print_before(F.lit(start).cast("date"), native))
        & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1))
    )
    return asof_ffill(widened, start, end, target, value)
