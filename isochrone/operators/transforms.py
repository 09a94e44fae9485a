"""Catalogue transformations of one variable, as DataFrame -> DataFrame functions on
``(ts, asset, value)``, and the registry that runs them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frequency import periods_per_year
from ..functions.numeric import ratio, safe_log
from .panel import difference
from .series import carry_forward, rolling_mean, rolling_std, with_windows


def rolling_zscore(df: DataFrame, window: int, value: str = "value") -> DataFrame:
    x = F.col(value)
    return with_windows(
        df, ["asset"], lambda w: {value: ratio(x - rolling_mean(x, w, window), rolling_std(x, w, window))}, before=window - 1
    )


def log_return(df: DataFrame, window: int = 1, value: str = "value") -> DataFrame:
    x = F.col(value)
    return with_windows(df, ["asset"], lambda w: {value: safe_log(ratio(x, F.lag(x, window).over(w)))}, before=window)


def yoy_pct_change(df: DataFrame, frequency: str, value: str = "value") -> DataFrame:
    """x / x one year back - 1. Missing values are carried forward first."""
    periods = periods_per_year(frequency)
    x = F.col(value)
    return with_windows(
        carry_forward(df, ["asset"], [value]), ["asset"],
        lambda w: {value: ratio(x, F.lag(x, periods).over(w)) - 1}, before=periods,
    )


def rolling_vol(df: DataFrame, window: int, frequency: str = "daily", annualised: bool = False, value: str = "value") -> DataFrame:
    x = F.col(value)
    factor = periods_per_year(frequency) ** 0.5 if annualised else 1.0
    return with_windows(df, ["asset"], lambda w: {value: rolling_std(x, w, window) * F.lit(factor)}, before=window - 1)


TRANSFORMATIONS: dict[str, Callable[..., DataFrame]] = {
    "rolling_zscore": rolling_zscore,
    "log_return": log_return,
    "yoy_pct_change": yoy_pct_change,
    "rolling_vol": rolling_vol,
    "difference": lambda lhs, rhs: difference(lhs, rhs, ["ts", "asset"]),
}


def run_transformation(spec: dict, read: Callable[[str], DataFrame], specs: dict[str, dict] | None = None) -> DataFrame:
    """Run a transformed-variable spec.

    ``read`` gives the rows of a raw variable. A source that is itself transformed (found in
    ``specs``) is expanded in place, so a chain is one lazy plan.
    """
    specs = specs or {}
    name = spec.get("transformation")
    if name not in TRANSFORMATIONS:
        raise ValueError(f"unknown transformation {name!r}. Must be one of {sorted(TRANSFORMATIONS)}.")

    def source(variable: str) -> DataFrame:
        known = specs.get(variable)
        if known is not None and known.get("frequency", spec["frequency"]) != spec["frequency"]:
            raise ValueError(f"source {variable!r} has frequency {known['frequency']!r}, expected {spec['frequency']!r}.")
        if known is not None and "transformation" in known:
            return run_transformation(known, read, specs)
        return read(variable)

    if name == "difference":
        if len(spec.get("sources", [])) != 2:
            raise ValueError("difference requires two sources.")
        return TRANSFORMATIONS[name](*(source(v) for v in spec["sources"]))
    if not isinstance(spec.get("source_variable"), str):
        raise ValueError("a transformation requires 'source_variable'.")
    params = {k: spec[k] for k in ("window", "annualised") if k in spec}
    if name in ("yoy_pct_change", "rolling_vol"):
        params["frequency"] = spec["frequency"]
    return TRANSFORMATIONS[name](source(spec["source_variable"]), **params)
