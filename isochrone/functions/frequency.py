"""Frequency constants and their column forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sampling frequencies and what each one implies.
FREQUENCIES = ("daily", "weekly", "monthly", "quarterly")
PERIODS_PER_YEAR = {"daily": 252, "weekly": 52, "monthly": 12, "quarterly": 4}
ROLLING_IC_WINDOW = {"daily": 63, "weekly": 13, "monthly": 3, "quarterly": 1}
FREQUENCY_RANK = {"daily": 0, "weekly": 1, "monthly": 2, "quarterly": 3}
PUBLICATION_LAG_DAYS = {"daily": 1, "weekly": 7, "monthly": 45, "quarterly": 120}
TRADING_DAYS = 252.0


def check_frequency(frequency: str) -> str:
    if frequency not in PERIODS_PER_YEAR:
        raise ValueError(f"Unknown frequency {frequency!r}; there are {', '.join(sorted(FREQUENCIES))}")
    return frequency


def periods_per_year(frequency: str) -> int:
    return PERIODS_PER_YEAR[check_frequency(frequency)]


def _lookup(column: Column, table: dict, default=None) -> Column:
    out = F
    for name, value in table.items():
        out = out.when(column == name, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def periods_per_year_col(frequency: Column) -> Column:
    """Periods per year; an unknown frequency fails the query."""
    return F.coalesce(
        _lookup(frequency, PERIODS_PER_YEAR),
        F.raise_error(F.concat(F.lit("Unknown frequency: "), frequency)).cast("int"),
    )


def frequency_rank_col(frequency: Column) -> Column:
    return _lookup(frequency, FREQUENCY_RANK, 0)


def publication_lag_col(frequency: Column) -> Column:
    return _lookup(frequency, PUBLICATION_LAG_DAYS, 1)
