"""Business-day arithmetic and period labels in closed form, so no calendar table is joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frequency import check_frequency


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def add_business_days(d: Column, n: int) -> Column:
    """Move a date by ``n`` Mon-Fri days. A weekend counts as the Friday before when moving
    forward and as the Monday after otherwise."""
    wd = F.weekday(d)
    if n > 0:
        base = F.date_sub(d, F.greatest(wd - 4, F.lit(0)))
        start = F.least(wd, F.lit(4))
    else:
        base = F.when(wd > 4, F.date_add(d, 7 - wd)).otherwise(d)
        start = F.when(wd > 4, F.lit(0)).otherwise(wd)
    target = start + F.lit(n)
    weeks = F.floor(target / F.lit(5)).cast("int")
    return F.date_add(base, weeks * 7 + (target - weeks * 5) - start)


def first_business_day(d: Column) -> Column:
    """The date itself, or the Monday after a weekend."""
    return F.when(F.weekday(d) > 4, F.date_add(d, 7 - F.weekday(d))).otherwise(d)


def last_business_day(d: Column) -> Column:
    """The date itself, or the Friday before a weekend."""
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def week_friday(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 1), "FRI")


def period_end(ts: Column, frequency: str) -> Column:
    """Catalogue labels: Friday, month end, quarter end."""
    check_frequency(frequency)
    d = F.to_date(ts)
    if frequency == "weekly":
        return week_friday(d)
    if frequency == "monthly":
        return F.last_day(d)
    if frequency == "quarterly":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return d


def period_start(ts: Column, frequency: str) -> Column:
    """Evaluation labels: Friday, month start, quarter start."""
    check_frequency(frequency)
    d = F.to_date(ts)
    if frequency == "weekly":
        return week_friday(d)
    if frequency == "monthly":
        return F.trunc(d, "month")
    if frequency == "quarterly":
        return F.trunc(d, "quarter")
    return d


def period_sequence(first: Column, last: Column, frequency: str, label: str = "start") -> Column:
    """Array of all period labels from ``first`` to ``last`` (both already labels)."""
    check_frequency(frequency)
    if frequency == "daily":
        days = F.sequence(first, last, F.expr("interval 1 day"))
        return F.filter(days, lambda d: F.weekday(d) < 5)
    if frequency == "weekly":
        return F.sequence(first, last, F.expr("interval 7 day"))
    unit = "month" if frequency == "monthly" else "quarter"
    step = F.expr("interval 1 month" if frequency == "monthly" else "interval 3 month")
    starts = F.sequence(F.trunc(first, unit), F.trunc(last, unit), step)
    if label == "start":
        return starts
    ahead = 0 if frequency == "monthly" else 2
    return F.transform(starts, lambda d: F.last_day(F.add_months(d, ahead)))


def one_print_before(start: Column, frequency: str) -> Column:
    """How far back to load so that one earlier print can be carried into ``start``."""
    check_frequency(frequency)
    if frequency == "monthly":
        return F.trunc(F.date_sub(start, 1), "month")
    if frequency == "quarterly":
        return F.trunc(F.date_sub(start, 1), "quarter")
    if frequency == "weekly":
        return F.date_sub(F.next_day(F.date_sub(start, 1), "FRI"), 7)
    return add_business_days(start, -1)
