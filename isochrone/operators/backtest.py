"""Out-of-sample return tables and their statistics.

The portfolio rules are causal, so the weights of all dates come from one pass and every test
window, fold or path is a join of dates to that one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frequency import TRADING_DAYS
from ..functions.numeric import ratio, safe_log
from ..functions.spark import materialise
from .panel import asof_signal, price_panel
from .portfolio import apply_costs, construct_portfolio
from .series import rolling_mean, rolling_std, running, with_positions, with_windows

ANNUAL = TRADING_DAYS
ROOT = TRADING_DAYS**0.5


def portfolio_returns(
    weights: DataFrame, prices: DataFrame, reference_asset=None, scope: list[str] | None = None
) -> DataFrame:
    """Gross return of each date: weights times the next log return of each asset.

    ``reference_asset`` prices the whole net weight on that one instrument instead. The last date
    has no forward return, so its gross return is missing.
    """
    scope = scope or []
    p = F.col("value")
    ahead = with_windows(
        prices, [*scope, "asset"], lambda w: {"_fwd": safe_log(F.lead(p, 1).over(w)) - safe_log(p)}, after=1
    )
    if reference_asset is not None:
        ref = ahead.filter(F.col("asset") == F.lit(reference_asset)).select(*scope, "ts", "_fwd")
        net_weight = weights.groupBy(*scope, "ts").agg(F.sum("weight").alias("_w"))
        return net_weight.join(ref, [*scope, "ts"], "left").select(*scope, "ts", (F.col("_w") * F.col("_fwd")).alias("gross"))
    joined = weights.join(ahead.select(*scope, "ts", "asset", "_fwd"), [*scope, "ts", "asset"], "left")
    return joined.groupBy(*scope, "ts").agg(F.sum(F.col("weight") * F.col("_fwd")).alias("gross"))


def wealth_curve(returns: DataFrame, keys: list[str], ret: str = "net", out: str = "wealth") -> DataFrame:
    """Running product of (1 + r); a missing return leaves wealth unchanged."""
    return running(returns, keys, {out: ("product", F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0)))})


def looks_simple(returns: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Whether the median absolute value says simple returns (< 0.5) rather than log-like ones."""
    return returns.groupBy(*keys).agg((F.coalesce(F.median(F.abs(ret)), F.lit(0.0)) < 0.5).alias("is_simple"))


def cum_returns(returns: DataFrame, keys: list[str], ret: str = "ret", kind: str = "auto") -> DataFrame:
    """Cumulative return: product of (1 + r) - 1, or exp(sum r) - 1 for log-like data."""
    both = running(
        returns, keys,
        {"_prod": ("product", F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))), "_sum": ("sum", F.coalesce(F.col(ret), F.lit(0.0)))},
    )
    simple, log_like = F.col("_prod") - 1, F.exp("_sum") - 1
    if kind == "auto":
        both = both.join(looks_simple(returns, keys, ret), keys)
        value = F.when(F.col("is_simple"), simple).otherwise(log_like)
    else:
        value = simple if kind == "simple" else log_like
    return both.select(*keys, "ts", value.alias("cum_return"))


def drawdown(returns: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    """Adds ``wealth``, ``peak`` and ``drawdown``; the start capital of 1 is not a peak."""
    curve = running(wealth_curve(returns, keys, ret), keys, {"peak": ("max", F.col("wealth"))})
    return curve.withColumn("drawdown", F.col("wealth") / F.col("peak") - 1)


def drawdown_duration(returns: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    """Rows from the high before the deepest trough until wealth is back at it (or the last row).

    One row per key: ``max_drawdown`` and ``max_drawdown_duration``.
    """
    curve = drawdown(with_positions(returns.filter(F.col(ret).isNotNull()), keys), keys, ret)
    trough = curve.groupBy(*keys).agg(
        F.min_by(F.struct("pos", "peak"), F.struct("drawdown", "pos")).alias("_t"),
        F.min("drawdown").alias("max_drawdown"), F.max("pos").alias("_last"), F.count(F.lit(1)).alias("_rows"),
    ).select(*keys, "max_drawdown", "_last", "_rows", F.col("_t.pos").alias("_trough"), F.col("_t.peak").alias("_peak"))
    joined = curve.select(*keys, "pos", "wealth").join(trough, keys)
    at_peak = F.abs(F.col("wealth") - F.col("_peak")) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs("_peak"))
    episode = joined.groupBy(*keys, "max_drawdown", "_last", "_rows").agg(
        F.max(F.when((F.col("pos") <= F.col("_trough")) & at_peak, F.col("pos"))).alias("_start"),
        F.min(F.when((F.col("pos") > F.col("_trough")) & (F.col("wealth") >= F.col("_peak") - 1e-12), F.col("pos"))).alias("_back"),
    )
    length = F.coalesce("_back", "_last") - F.coalesce(F.col("_start"), F.lit(0))
    none = (F.col("_rows") < 2) | (F.col("max_drawdown") >= -1e-15)
    return episode.select(*keys, "max_drawdown", F.when(none, F.lit(0)).otherwise(length).cast("int").alias("max_drawdown_duration"))


def return_stats(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of ``(keys, ts, net)``: annualised mean and deviation, Sharpe, Sortino, hit rate,
    maximum drawdown and its length, Calmar. A missing net return counts as zero."""
    filled = returns.select(*keys, "ts", F.coalesce("net", F.lit(0.0)).alias("net"))
    n = F.col("net")
    base = filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.avg(n).alias("_mean"), F.stddev_samp(n).alias("_sd"),
        F.stddev_samp(F.least(n, F.lit(0.0))).alias("_down"), F.avg(F.when(n > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    out = base.join(drawdown_duration(filled, keys), keys)
    annual = F.when(F.col("_rows") >= 2, F.col("_mean") * ANNUAL)
    return out.select(
        *keys, annual.alias("annualised_return"), (F.col("_sd") * ROOT).alias("annualised_vol"),
        (ratio(F.col("_mean"), F.col("_sd")) * ROOT).alias("sharpe_ratio"),
        (ratio(F.col("_mean"), F.col("_down")) * ROOT).alias("sortino_ratio"),
        "max_drawdown", "max_drawdown_duration",
        F.when(F.col("max_drawdown") < -1e-15, annual / F.abs("max_drawdown")).alias("calmar_ratio"), "hit_rate",
    )


def trade_stats(returns: DataFrame, traded: DataFrame, keys: list[str]) -> DataFrame:
    """Average gross return on trading dates, total cost in bps, annual turnover.

    ``returns(keys, ts, gross, net)``, ``traded(keys, ts, asset, trade)``.
    """
    moved = traded.groupBy(*keys, "ts").agg(F.sum(F.abs("trade")).alias("_moved"))
    days = returns.join(moved, [*keys, "ts"], "left").withColumn("_moved", F.coalesce("_moved", F.lit(0.0)))
    net = F.coalesce(F.col("net"), F.lit(0.0))
    return days.groupBy(*keys).agg(
        F.avg(F.when(F.col("_moved") > 0, F.col("gross"))).alias("avg_trade_return"),
        F.coalesce(F.sum((F.col("gross") - net) * 10000), F.lit(0.0)).alias("total_cost_bps"),
        (F.avg("_moved") * ANNUAL).alias("turnover_annual"),
    )


def avg_sharpe_clean(returns: DataFrame, keys: list[str], ret: str = "ret", periods: float = 252.0) -> DataFrame:
    """Annualised Sharpe of the finite values: missing below two, -inf for a constant series."""
    x = F.when(F.isnan(ret) | (F.abs(F.col(ret)) == float("inf")), None).otherwise(F.col(ret))
    sd = F.stddev_samp(x)
    value = F.when(F.count(x) < 2, None).when(sd == 0, F.lit(float("-inf"))).otherwise(F.try_divide(F.avg(x), sd) * periods**0.5)
    return returns.groupBy(*keys).agg(value.alias("sharpe"))


def rolling_sharpe(returns: DataFrame, keys: list[str], ret: str = "net", window: int = 252, least: int = 20) -> DataFrame:
    x = F.col(ret)
    return with_windows(
        returns, keys,
        lambda w: {"rolling_sharpe": ratio(rolling_mean(x, w, window, least), rolling_std(x, w, window, least)) * ROOT}, before=window - 1,
    )


def rolling_mean_ic(ic: DataFrame, keys: list[str], window: int) -> DataFrame:
    return with_windows(ic, keys, lambda w: {"rolling_ic": rolling_mean(F.col("ic"), w, window)}, before=window - 1)


def backtest_days(
    signal: Callable[[DataFrame], DataFrame] | DataFrame,
    prices: DataFrame,
    classes: DataFrame | None = None,
    config: dict | None = None,
    reference_asset=None,
    spreads: DataFrame | None = None,
    scope: list[str] | None = None,
    bound: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Daily gross and net returns and trades over the whole calendar of ``prices``.

    ``signal`` is a signal table, or a function of the price table. ``config`` holds the
    ``construct_portfolio`` settings.
    """
    config = dict(config or {})
    if "instruments" in config:
        raise ValueError("instruments are those of the signal, not a portfolio setting")
    scope = scope or []
    raw = signal(prices) if callable(signal) else signal
    # each of these tables is read several times below and by the statistics: written once
    panel = materialise(price_panel(prices, scope=scope), "prices")
    calendar = panel.select(*scope, "ts").distinct()
    instruments = panel.select(*scope, "asset").distinct()
    sampled = asof_signal(raw, calendar, instruments, scope)
    book = materialise(construct_portfolio(sampled, panel, classes, scope=scope, bound=bound, **config), "book")
    gross = portfolio_returns(book, panel, reference_asset, scope)
    days = materialise(apply_costs(gross, book, spreads, scope=scope), "days")
    return days, book.select(*scope, "ts", "asset", "trade")


def backtest_result(days: DataFrame, traded: DataFrame, keys: list[str]) -> DataFrame:
    """One row of statistics per key."""
    return return_stats(days, keys).join(trade_stats(days, traded, keys), keys)


def backtest(days: DataFrame, traded: DataFrame, train_window: int, test_window: int) -> tuple[DataFrame, DataFrame]:
    """Restrict daily results to the last ``test_window`` dates; needs train + test rows."""
    calendar = days.select("ts").distinct()
    rows = calendar.count()
    if rows < train_window + test_window:
        raise ValueError(f"{rows} calendar rows are too few for {train_window} to train and {test_window} to test")
    test = calendar.orderBy(F.desc("ts")).limit(test_window)
    return days.join(test, "ts", "left_semi"), traded.join(test, "ts", "left_semi")
