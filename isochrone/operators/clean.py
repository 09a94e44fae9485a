"""Gap filling and outlier flags per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.spark import is_date, require_none
from .series import running, trailing_moments, with_windows

# Fixed values of the cleaning policy.
MAX_FILL_ROWS = 3
OUTLIER_WINDOW = 252
OUTLIER_SIGMA = 5.0


def limited_ffill(df: DataFrame, limit: int = MAX_FILL_ROWS, value: str = "close", keys: list[str] | None = None) -> DataFrame:
    """Fill a missing value from at most ``limit`` rows back; adds ``filled``."""
    def build(w):
        return {"_fill": F.last(value, ignorenulls=True).over(w.rowsBetween(-limit, 0))}

    out = with_windows(df, keys or ["asset"], build, before=limit)
    return out.withColumn("filled", F.col(value).isNull() & F.col("_fill").isNotNull()).withColumn(value, F.col("_fill")).drop("_fill")


def gap_violations(df: DataFrame, limit: int = MAX_FILL_ROWS, value: str = "close", keys: list[str] | None = None) -> DataFrame:
    """Series that a bounded fill must refuse: ``bad_rows`` missing values are more than ``limit``
    rows after the last known one (a longer run, or missing from the start)."""
    keys = keys or ["asset"]
    filled = limited_ffill(df, limit, value, keys)
    bad = filled.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("bad_rows"), F.min(F.when(F.col(value).isNull(), F.col("ts"))).alias("first_bad"))
    return bad.filter("bad_rows > 0")


def missing_runs(df: DataFrame, value: str = "close", keys: list[str] | None = None) -> DataFrame:
    """Consecutive missing rows as ``(keys, run_start, run_end, run_length)``.

    A run is named by the number of present rows before it.
    """
    keys = keys or ["asset"]
    numbered = running(df, keys, {"_run": ("sum", F.when(F.col(value).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)))})
    return numbered.filter(F.col(value).isNull()).groupBy(*keys, "_run").agg(
        F.min("ts").alias("run_start"), F.max("ts").alias("run_end"), F.count(F.lit(1)).alias("run_length")
    ).drop("_run")


def bounded_ffill(
    df: DataFrame, limit: int = MAX_FILL_ROWS, value: str = "close", strict: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """Fill short gaps and mark them ``fill_type='ffill'``; series with a longer gap, or missing at
    the start, are left out (or fail the call when ``strict``)."""
    keys = keys or ["asset"]
    filled = limited_ffill(df, limit, value, keys)
    marked = filled.withColumn("fill_type", F.when(F.col("filled"), F.lit("ffill"))).drop("filled")
    return _complete(marked, value, keys, f"missing data gap exceeds {limit} rows" if strict else None)


def source_ffill(
    df: DataFrame, limit: int = MAX_FILL_ROWS, value: str = "close", strict: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """Vendor-side variant: fill up to ``limit`` rows and refuse series with anything still missing."""
    keys = keys or ["asset"]
    filled = limited_ffill(df, limit, value, keys).drop("filled")
    return _complete(filled, value, keys, "missing values remain after forward fill" if strict else None)


def _complete(filled: DataFrame, value: str, keys: list[str], error: str | None) -> DataFrame:
    """Only the series without a missing value; with ``error``, none may have one."""
    open_rows = filled.filter(F.col(value).isNull()).select(*keys).distinct()
    if error:
        require_none(open_rows, error)
        return filled
    if is_date(filled, "ts"):  # a series is small then and lies in one place after the fill: no second pass
        missing = F.count_if(F.col(value).isNull()).over(Window.partitionBy(*keys))
        return filled.withColumn("_missing", missing).filter("_missing = 0").drop("_missing")
    return filled.join(open_rows, keys, "left_anti")


def flag_outliers(
    df: DataFrame, window: int = OUTLIER_WINDOW, sigma: float = OUTLIER_SIGMA, value: str = "close", keys: list[str] | None = None
) -> DataFrame:
    """|x - rolling mean| / rolling std above ``sigma``; the window includes the row itself."""
    moved = trailing_moments(df, keys or ["asset"], value, window, "_mean", "_std")
    z = ratio(F.abs(F.col(value) - F.col("_mean")), F.col("_std"))
    return moved.withColumn("is_outlier", F.coalesce(z > sigma, F.lit(False))).drop("_mean", "_std")


def clean_series(
    df: DataFrame, limit: int = MAX_FILL_ROWS, window: int = OUTLIER_WINDOW, version: int = 1, strict: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """Fill, flag and stamp the cleaning version."""
    out = flag_outliers(bounded_ffill(df, limit, strict=strict, keys=keys), window, keys=keys)
    return out.withColumn("clean_version", F.lit(version))
