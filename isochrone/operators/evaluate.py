"""Signal scorecards. Every step is keyed by ``scope`` (e.g. signal) and ``horizon``, so all
signals and horizons are scored in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frequency import ROLLING_IC_WINDOW, check_frequency, periods_per_year
from ..functions.numeric import pearson, rank_correlation, ratio, safe_log
from ..functions.spark import materialise
from .cross import cross_ic, rank_within
from .resample import resample_first_nonzero, resample_sum_returns
from .series import with_positions, with_windows

ForwardReturns = Callable[[DataFrame, str], DataFrame]


def log_returns_panel(prices: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """ln p - ln previous p per asset, on the rows of the panel."""
    p = F.col("value")
    return with_windows(
        prices, [*(scope or []), "asset"], lambda w: {"value": safe_log(p) - safe_log(F.lag(p, 1).over(w))}, before=1
    )


def forward_return(returns: DataFrame, horizons: list[int], scope: list[str] | None = None) -> DataFrame:
    """The one-period return ``horizon + 1`` rows ahead (the extra row is the execution lag), for
    all horizons in one pass: ``(scope, horizon, ts, asset, fwd)``."""
    if not horizons or min(horizons) <= 0:
        raise ValueError("a horizon counts rows ahead: it must be positive")
    scope = scope or []
    ahead = with_windows(
        returns, [*scope, "asset"], lambda w: {f"_h{h}": F.lead("value", h + 1).over(w) for h in horizons}, after=max(horizons) + 1
    )
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("fwd")) for h in horizons])
    return ahead.select(*scope, "ts", "asset", F.explode(rows).alias("_r")).select(
        *scope, "_r.horizon", "ts", "asset", "_r.fwd"
    )


def paired(signal: DataFrame, forward: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rows with both sides present: ``(scope, horizon, ts, asset, signal, fwd)``."""
    s = signal.filter(F.col("value").isNotNull()).withColumnRenamed("value", "signal").drop("pos", "_move")
    shared = [c for c in (scope or []) if c in forward.columns]
    return s.join(forward.filter(F.col("fwd").isNotNull()), [*shared, "ts", "asset"])


def ic_by_date(pairs: DataFrame, keys: list[str] | None = None, bound: int | None = None) -> DataFrame:
    return cross_ic(pairs, ["ts", *(keys or [])], "signal", "fwd", bound=bound)


def _ic_stats():
    return (
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        (F.count_if(F.col("ic") > 0) / F.count(F.lit(1))).alias("ic_positive_pct"),
    )


def ic_summary(ic: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and ratio of the IC; the positive share counts missing dates below."""
    out = ic.groupBy(*keys).agg(*_ic_stats())
    return out.withColumn("icir", ratio(F.col("ic_mean"), F.col("ic_std")))


def hit_rate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of non-zero signals whose sign matches the forward return."""
    hit = F.when(F.signum("signal") == F.signum("fwd"), 1.0).otherwise(0.0)
    return pairs.groupBy(*keys).agg(F.avg(F.when(F.col("signal") != 0, hit)).alias("hit_rate"))


def hit_rate_by_date(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Hit share per date (zeros included), then the mean over dates."""
    hit = F.when(F.signum("signal") == F.signum("fwd"), 1.0).otherwise(0.0)
    by_date = pairs.groupBy(*keys, "ts").agg(F.avg(hit).alias("_h"))
    return by_date.groupBy(*keys).agg(F.avg("_h").alias("hit_rate_by_date"))


def signal_sharpe(pairs: DataFrame, keys: list[str], frequency: str) -> DataFrame:
    """Annualised Sharpe of the per-date mean of signal x forward return."""
    by_date = pairs.groupBy(*keys, "ts").agg(F.avg(F.col("signal") * F.col("fwd")).alias("_pnl"))
    sharpe = ratio(F.avg("_pnl"), F.stddev_samp("_pnl")) * F.lit(periods_per_year(frequency) ** 0.5)
    return by_date.groupBy(*keys).agg(sharpe.alias("signal_sharpe"))


def signal_turnover(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute change between consecutive panel dates; a gap breaks both differences.

    Instead of filling the panel, a change counts only when the asset's previous row is on the
    previous date of the panel's calendar.
    """
    calendar = with_positions(signal.select(*keys, "ts").distinct(), keys).withColumnRenamed("pos", "_date")
    dated = signal.select(*keys, "asset", "ts", "value").join(calendar, [*keys, "ts"])

    def build(w):
        change = F.abs(F.col("value") - F.lag("value", 1).over(w))
        return {"_d": F.when(F.lag("_date", 1).over(w) == F.col("_date") - 1, change)}

    return with_windows(dated, [*keys, "asset"], build, before=1).groupBy(*keys).agg(F.avg("_d").alias("turnover"))


def series_turnover(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Single-series variant: every ``keys`` group is its own series."""
    moved = with_windows(signal, keys, lambda w: {"_d": F.abs(F.col("value") - F.lag("value", 1).over(w))}, before=1)
    return moved.groupBy(*keys).agg(F.avg("_d").alias("turnover"))


def ic_decay_halflife(ic: DataFrame, keys: list[str]) -> DataFrame:
    """First lag at which the autocorrelation of the present IC values is at most one half.

    Lags run to min(252, n / 2); fewer than five values give missing. The IC has one row per date,
    so a window per key is small.
    """
    w = Window.partitionBy(*keys)
    present = (
        ic.filter(F.col("ic").isNotNull()).select(*keys, "ts", "ic")
        .withColumns({"_n": F.count(F.lit(1)).over(w), "pos": F.row_number().over(w.orderBy("ts"))})
    )
    top = F.least(F.lit(252), F.floor(F.col("_n") / 2).cast("int"))
    lagged = (
        present.filter("_n >= 5").withColumn("lag", F.explode(F.sequence(F.lit(1), top)))
        .select(*keys, "lag", (F.col("pos") + F.col("lag")).alias("pos"), F.col("ic").alias("_earlier"))
    )
    corr = (
        lagged.join(present.select(*keys, "pos", "ic"), [*keys, "pos"])
        .groupBy(*keys, "lag").agg(pearson(F.col("_earlier"), F.col("ic")).alias("_corr"), F.count(F.lit(1)).alias("_pairs"))
    )
    first = F.min(F.when((F.col("_corr") <= 0.5) & (F.col("_pairs") >= 3), F.col("lag"))).cast("double")
    found = corr.groupBy(*keys).agg(first.alias("decay_halflife"))
    return ic.select(*keys).distinct().join(found, keys, "left")


def rolling_spearman(pairs: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Spearman correlation of each trailing window of paired rows: ``(keys, ts, rolling_ic)``.

    Each row is sent to the windows it belongs to; ranks and correlation stay inside the window.
    All of it runs on the partitioning of the series blocks, so nothing is shuffled again.
    """
    placed = with_positions(pairs, keys)
    if window < 2:
        return placed.select(*keys, "ts", F.lit(None).cast("double").alias("rolling_ic"))
    block = F.floor(F.col("end") / F.lit(4096))
    spread = placed.withColumn("end", F.explode(F.sequence(F.col("pos"), F.col("pos") + (window - 1))))
    spread = spread.withColumn("_block", block).repartition(*keys, "_block")
    group = [*keys, "_block", "end"]

    def rank(c):
        w = Window.partitionBy(*group).orderBy(c)
        return (F.rank().over(w) + F.count(c).over(w)) / F.lit(2.0)

    ranked = spread.withColumns({"_rx": rank("signal"), "_ry": rank("fwd")})
    scored = ranked.groupBy(*group).agg(
        rank_correlation(F.col("_rx"), F.col("_ry")).alias("_ic"), F.count(F.lit(1)).alias("_rows"), F.max("pos").alias("_last"), F.max("ts").alias("ts")
    )
    # windows that run past the last row have no row of their own
    return scored.filter("_last = end").select(*keys, "ts", F.when(F.col("_rows") == window, F.col("_ic")).alias("rolling_ic"))


def _scorecard_inputs(signal, prices, horizons, frequency, forward_returns, scope):
    check_frequency(frequency)
    scope = scope or []
    returns = forward_returns(prices, frequency) if forward_returns else log_returns_panel(prices)
    sig = resample_first_nonzero(signal, frequency, scope=scope)
    if frequency != "daily":
        # resampled series have no holes, so the previous row is the previous period
        sig = with_windows(sig, [*scope, "asset"], lambda w: {"_move": F.abs(F.col("value") - F.lag("value", 1).over(w))}, before=1)
    # a signal may be any computation: it is computed once, then read for the pairs and the turnover
    sig = materialise(sig, "signal")
    fwd = forward_return(resample_sum_returns(returns, frequency), horizons)
    return sig, paired(sig, fwd, scope)


def signal_metrics_panel(
    signal: DataFrame,
    prices: DataFrame,
    horizons: list[int],
    frequency: str = "daily",
    scope: list[str] | None = None,
    bound: int | None = None,
    forward_returns: ForwardReturns | None = None,
) -> DataFrame:
    """Cross-sectional scorecard, one row per ``(scope, horizon)``.

    ``signal(scope..., ts, asset, value)``, ``prices(ts, asset, value)``. ``forward_returns``
    replaces the one-period log returns.
    """
    scope = scope or []
    run = scope or ["_run"]
    tagged = signal if scope else signal.withColumn("_run", F.lit(1))
    sig, pairs = _scorecard_inputs(tagged, prices, horizons, frequency, forward_returns, run)
    keys = [*run, "horizon"]
    by = ["ts", *keys]  # the date first: it sorts faster than names
    ranked = rank_within(rank_within(pairs, by, "signal", "_rx", bound), by, "fwd", "_ry", bound)
    hit = F.when(F.signum("signal") == F.signum("fwd"), 1.0).otherwise(0.0)
    # one row per (run, horizon, date) is all the rest needs: written once, read by every statistic
    by_date = materialise(ranked.groupBy(*by).agg(
        rank_correlation(F.col("_rx"), F.col("_ry")).alias("ic"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.col("signal") * F.col("fwd")).alias("_pnl"),
        F.sum(F.when(F.col("signal") != 0, hit)).alias("_hits"), F.count_if(F.col("signal") != 0).alias("_bets"),
    ), "scores")
    totals = by_date.groupBy(*keys).agg(
        F.sum("_n").alias("n_observations"), F.try_divide(F.sum("_hits"), F.sum("_bets")).alias("hit_rate"),
        (ratio(F.avg("_pnl"), F.stddev_samp("_pnl")) * F.lit(periods_per_year(frequency) ** 0.5)).alias("signal_sharpe"),
        *_ic_stats(),
    )
    moved = signal_turnover(sig, run) if frequency == "daily" else sig.groupBy(*run).agg(F.avg("_move").alias("turnover"))
    out = totals.join(ic_decay_halflife(by_date, keys), keys, "left").join(moved, run)
    return out.select(
        *scope, "horizon", F.lit(frequency).alias("frequency"), "ic_mean", "ic_std", ratio(F.col("ic_mean"), F.col("ic_std")).alias("icir"),
        "ic_positive_pct", "hit_rate", "signal_sharpe", "turnover", "decay_halflife", "n_observations",
    )


def full_sample_ic(pairs: DataFrame, keys: list[str], bound: int | None = None) -> DataFrame:
    """One Spearman correlation over all rows of each series."""
    return cross_ic(pairs, keys, "signal", "fwd", "ic_mean", bound)


def signal_metrics_single(
    signal: DataFrame,
    prices: DataFrame,
    horizons: list[int],
    frequency: str = "daily",
    bound: int | None = None,
    window: int | None = None,
    forward_returns: ForwardReturns | None = None,
) -> DataFrame:
    """Time-series scorecard, one row per ``(asset, horizon)``: each asset is its own signal.

    The IC is one full-sample rank correlation; its deviation is that of the rolling rank
    correlation, which needs at least two windows. ``bound`` limits the rows of a series.
    """
    sig, pairs = _scorecard_inputs(signal, prices, horizons, frequency, forward_returns, [])
    pairs = materialise(pairs, "pairs")
    keys = ["asset", "horizon"]
    rolled = rolling_spearman(pairs, keys, window or ROLLING_IC_WINDOW[frequency])
    enough = F.count("rolling_ic") >= 2
    spread = rolled.groupBy(*keys).agg(
        F.when(enough, F.stddev_samp("rolling_ic")).alias("ic_std"),
        F.when(enough, F.count_if(F.col("rolling_ic") > 0) / F.count(F.lit(1))).alias("ic_positive_pct"),
    )
    pnl = F.col("signal") * F.col("fwd")
    hit = F.when(F.signum("signal") == F.signum("fwd"), 1.0).otherwise(0.0)
    totals = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"), F.avg(F.when(F.col("signal") != 0, hit)).alias("hit_rate"),
        (ratio(F.avg(pnl), F.stddev_samp(pnl)) * F.lit(periods_per_year(frequency) ** 0.5)).alias("signal_sharpe"),
    )
    out = (
        totals.join(full_sample_ic(pairs, keys, bound), keys, "left").join(spread, keys, "left")
        .join(series_turnover(sig, ["asset"]), "asset", "left")
    )
    return out.select(
        *keys, F.lit(frequency).alias("frequency"), "ic_mean", "ic_std", ratio(F.col("ic_mean"), F.col("ic_std")).alias("icir"),
        "ic_positive_pct", "hit_rate", "signal_sharpe", "turnover", F.lit(1.0).alias("decay_halflife"), "n_observations",
    )


def metric_delta(baseline: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """|change| of IC and ICIR and change of N between two scorecards."""
    b = baseline.select(*keys, F.col("ic_mean").alias("b_ic"), F.col("icir").alias("b_icir"), F.col("n_observations").alias("b_n"))
    v = variant.select(*keys, F.col("ic_mean").alias("v_ic"), F.col("icir").alias("v_icir"), F.col("n_observations").alias("v_n"))
    return b.join(v, keys).select(
        *keys, F.abs(F.col("v_ic") - F.col("b_ic")).alias("delta_ic"),
        F.abs(F.col("v_icir") - F.col("b_icir")).alias("delta_icir"), (F.col("v_n") - F.col("b_n")).alias("delta_n"),
    )
