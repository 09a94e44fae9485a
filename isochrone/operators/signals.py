"""Signals and normalisation on ``(ts, asset, value)``.

``scope`` columns (fold, path, ...) keep runs apart; ``bound`` is the checked number of assets
(see ``cross``). A signal never sees the row it is dated on: inputs are lagged one row first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio
from .cross import order_within, rank_within
from .panel import dense_panel
from .resample import monthly_close_lagged
from .series import rolling_mean, rolling_std, with_windows


@dataclass(frozen=True)
class SignalSpec:
    """A plug-in signal: ``compute`` maps the long input table to ``(ts, asset, value)``."""

    name: str
    compute: Callable[[DataFrame], DataFrame]
    frequency: str = "daily"
    required_variables: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    evaluation_horizons: tuple[int, ...] = (1,)
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.name:
            raise ValueError("a signal needs a name.")
        if not self.evaluation_horizons or min(self.evaluation_horizons) <= 0:
            raise ValueError("evaluation horizons must be positive.")


def sma_crossover(df: DataFrame, fast: int = 50, slow: int = 200, scale_by_distance: bool = False, scope: list[str] | None = None) -> DataFrame:
    """Sign of fast minus slow moving average of the lagged close; zero is missing."""
    keys = [*(scope or []), "asset"]
    lagged = with_windows(df, keys, lambda w: {"_px": F.lag("value", 1).over(w)}, before=1)
    px = F.col("_px")
    out = with_windows(
        lagged, keys, lambda w: {"_fast": rolling_mean(px, w, fast), "_slow": rolling_mean(px, w, slow)}, before=max(fast, slow) - 1
    )
    gap = F.col("_fast") - F.col("_slow")
    raw = F.nullif(F.signum(gap), F.lit(0.0))
    if scale_by_distance:
        raw = raw * F.tanh(F.abs(ratio(gap, F.col("_slow"))) * 10)
    return out.select(*(scope or []), "ts", "asset", clip(raw, -1.0, 1.0).alias("value"))


def bucket_select(
    df: DataFrame, n_long: int, n_short: int, n_assets, by: list[str] | None = None, value: str = "value", bound: int | None = None
) -> DataFrame:
    """Keep the ``n_long`` highest and ``n_short`` lowest of a fixed universe; adds ``selected``.

    Ties go by asset order. Missing values are never selected, and the upper threshold counts the
    whole universe, so a date with missing values selects fewer longs.
    """
    placed = order_within(df, by or ["ts"], value, "asset", "_place", bound=bound)
    keep = (F.col("_place") > F.lit(n_assets) - n_long) | (F.col("_place") <= n_short)
    return placed.withColumn("selected", F.coalesce(keep, F.lit(False))).drop("_place")


def _ranked_buckets(df: DataFrame, value: str, n_long: int, n_short: int, n_assets, scope: list[str], bound: int | None) -> DataFrame:
    """Percentile rank scaled to [-1, 1] on the selected assets, zero elsewhere."""
    by = [*scope, "ts"]
    sized = rank_within(df, by, value, "_rank", bound, size="_n")
    chosen = bucket_select(sized, n_long, n_short, n_assets, by, value, bound)
    scaled = F.col("_rank") / F.col("_n") * 2 - 1
    return chosen.select(*by, "asset", F.when(F.col("selected"), scaled).otherwise(F.lit(0.0)).alias("value"))


def momentum_from_monthly(
    monthly: DataFrame, formation: int = 12, skip: int = 1, n_assets: int | None = None, scope: list[str] | None = None,
    bound: int | None = None, is_dense: bool = False,
) -> DataFrame:
    """Cross-sectional momentum on lagged month-end prices: past return without the last ``skip``
    months, ranked, top and bottom decile of the universe kept.

    ``is_dense`` says that the panel already has every asset on every date.
    """
    scope = scope or []
    n = n_assets if n_assets is not None else monthly.select("asset").distinct().count()
    k = max(1, int(n * 0.1))
    dense = monthly if is_dense else dense_panel(monthly, scope=scope)
    p = F.col("value")
    past = with_windows(
        dense, [*scope, "asset"],
        lambda w: {"_ret": ratio(F.lag(p, skip).over(w), F.lag(p, skip + formation).over(w)) - 1}, before=skip + formation,
    )
    return _ranked_buckets(past, "_ret", k, k, n, scope, bound)


def momentum_signal(df: DataFrame, formation: int = 12, skip: int = 1, n_assets: int | None = None, scope: list[str] | None = None, bound: int | None = None) -> DataFrame:
    """Momentum from daily closes."""
    return momentum_from_monthly(monthly_close_lagged(df, scope=scope), formation, skip, n_assets, scope, bound)


def carry_signal(
    rates: DataFrame, base, n_long: int = 3, n_short: int = 3, smooth: int = 1, n_pairs: int | None = None, bound: int | None = None
) -> DataFrame:
    """Rank every currency's lagged rate against the base; keep the top and bottom pairs.

    ``rates(ts, asset, value)``; output assets are the quote currencies. ``n_pairs`` is the declared
    number of pairs (counted when not given).
    """
    lagged = with_windows(rates, ["asset"], lambda w: {"value": F.lag("value", 1).over(w)}, before=1)
    pair_count = n_pairs or rates.filter(F.col("asset") != F.lit(base)).select("asset").distinct().count()
    is_base = F.col("asset") == F.lit(base)
    # every pair on the union of all dates, so a date of only one leg is a missing difference
    grid = dense_panel(lagged.withColumn("_own", F.lit(True)))
    base_leg = lagged.filter(is_base).select("ts", F.col("value").alias("_base"), F.lit(True).alias("_has_base"))
    diff = (
        grid.filter(~is_base).join(base_leg, "ts", "left")
        .withColumn("_diff", F.col("value") - F.col("_base"))
    )
    if smooth > 1:
        d = F.col("_diff")
        on_index = diff.filter(F.coalesce("_own", "_has_base", F.lit(False)))
        smoothed = with_windows(on_index, ["asset"], lambda w: {"_diff": rolling_mean(d, w, smooth)}, before=smooth - 1)
        diff = diff.drop("_diff").join(smoothed.select("ts", "asset", "_diff"), ["ts", "asset"], "left")
    longs = max(0, min(n_long, pair_count))
    shorts = max(0, min(n_short, pair_count - longs))
    return _ranked_buckets(diff.select("ts", "asset", "_diff"), "_diff", longs, shorts, pair_count, [], bound)


def normalise_zscore(df: DataFrame, window: int = 252, scope: list[str] | None = None) -> DataFrame:
    """Rolling z-score per asset, clipped at three and scaled to [-1, 1]."""
    x = F.col("value")
    return with_windows(
        df, [*(scope or []), "asset"],
        lambda w: {"value": clip(ratio(x - rolling_mean(x, w, window), rolling_std(x, w, window)), -3.0, 3.0) / 3}, before=window - 1,
    )


def normalise_rank(df: DataFrame, by: list[str] | None = None, bound: int | None = None) -> DataFrame:
    """Average-tie percentile rank per date, scaled to (-1, 1]."""
    by = by or ["ts"]
    sized = rank_within(df, by, "value", "_rank", bound, size="_n")
    return sized.withColumn("value", F.col("_rank") / F.col("_n") * 2 - 1).drop("_rank", "_n")


def look_ahead_rows(compute: Callable[[DataFrame], DataFrame], data: DataFrame, as_of, factor: float = 2.0) -> DataFrame:
    """Look-ahead audit: signal rows up to ``as_of`` that change when later inputs are changed.

    A causal signal gives no rows.
    """
    cut = F.lit(as_of).cast("date")
    shifted = data.withColumn("value", F.when(F.col("ts") > cut, F.col("value") * factor + 1).otherwise(F.col("value")))
    before = compute(data).filter(F.col("ts") <= cut).select("ts", "asset", "value")
    after = compute(shifted).filter(F.col("ts") <= cut).select("ts", "asset", "value")
    return before.exceptAll(after).unionByName(after.exceptAll(before))
