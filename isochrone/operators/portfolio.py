"""Signals and prices to weights, trades and costs. Long tables ``(scope..., ts, asset, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frequency import TRADING_DAYS
from ..functions.numeric import ratio, safe_log
from ..functions.spark import require_none
from .cross import order_within, totals_within
from .series import carry_forward, rolling_std, with_windows

# Default cost spreads in basis points.
FX_SPREAD_BPS = 1.5
TREASURY_ETF_SPREAD_BPS = 2.0
EQUITY_SPREAD_BPS = 5.0
TREASURY_ETFS = ("TLT", "IEF", "SHY")
DEFAULT_IMPACT_COEFFICIENT = 10.0


def realised_vol(prices: DataFrame, window: int = 60, scope: list[str] | None = None) -> DataFrame:
    """Annualised rolling deviation of log returns, carried forward: adds ``vol``."""
    if window <= 1:
        raise ValueError("vol_window: volatility needs at least two returns")
    keys = [*(scope or []), "asset"]
    p = F.col("value")
    ret = with_windows(prices, keys, lambda w: {"_r": safe_log(p) - safe_log(F.lag(p, 1).over(w))}, before=1)
    r = F.col("_r")
    raw = with_windows(
        ret, keys, lambda w: {"vol": rolling_std(r, w, window) * F.lit(TRADING_DAYS**0.5)}, before=window - 1
    )
    return carry_forward(raw.drop("_r"), keys, ["vol"])


def _with_vol(signals: DataFrame, prices: DataFrame, window: int, scope: list[str], strict: bool) -> DataFrame:
    """Signals with the volatility of their own dates; ``prices`` on other dates are not used."""
    if strict:
        require_none(signals.select("asset").distinct().join(prices.select("asset").distinct(), "asset", "left_anti"), "prices missing for signals")
    on = [*scope, "ts", "asset"]
    on_dates = signals.select(*on, F.col("value").alias("signal")).join(prices.select(*on, "value"), on, "left")
    return realised_vol(on_dates, window, scope)


def scale_to_target_vol(df: DataFrame, target_vol: float = 0.10, scope: list[str] | None = None, bound: int | None = None) -> DataFrame:
    """Scale ``weight`` per date so that sqrt(sum (w vol)^2) meets the target; zero risk gives zero."""
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    square = F.pow(w * F.coalesce(F.col("vol"), F.lit(0.0)), F.lit(2.0))
    sized = totals_within(df, [*(scope or []), "ts"], {"_ss": F.sum(square)}, bound).withColumn("_risk", F.sqrt("_ss"))
    scale = F.coalesce(ratio(F.lit(target_vol), F.col("_risk")), F.lit(0.0))
    return sized.withColumn("weight", w * scale).drop("_risk", "_ss")


def vol_target_weights(
    signals: DataFrame, prices: DataFrame, target_vol: float = 0.10, vol_window: int = 60,
    scope: list[str] | None = None, bound: int | None = None, strict: bool = False,
) -> DataFrame:
    """signal x target / vol, scaled to the portfolio target; missing is zero."""
    sized = _with_vol(signals, prices, vol_window, scope or [], strict)
    raw = sized.withColumn("weight", F.col("signal") * ratio(F.lit(target_vol), F.col("vol")))
    out = scale_to_target_vol(raw, target_vol, scope, bound)
    return out.select(*(scope or []), "ts", "asset", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def risk_parity_weights(
    signals: DataFrame, prices: DataFrame, classes: DataFrame, target_vol: float = 0.10, vol_window: int = 60,
    scope: list[str] | None = None, bound: int | None = None, strict: bool = False,
) -> DataFrame:
    """Equal budget per asset class, signal / vol shares inside a class, then scaled.

    ``classes(asset, cls)`` must map every instrument; the budget counts the classes of the universe.
    """
    scope = scope or []
    universe = signals.select("asset").distinct()
    if strict:
        require_none(universe.join(classes, "asset", "left_anti"), "asset classes missing for")
    budget = classes.join(universe, "asset", "left_semi").agg((F.lit(1.0) / F.count_distinct("cls"))).scalar()
    sized = _with_vol(signals, prices, vol_window, scope, strict).join(classes.select("asset", "cls"), "asset")
    raw = sized.withColumn("_raw", ratio(F.col("signal"), F.col("vol")))
    shared = totals_within(raw, [*scope, "ts", "cls"], {"_gross": F.sum(F.abs("_raw"))}, bound)
    weighted = shared.withColumn("weight", F.coalesce(ratio(F.col("_raw"), F.col("_gross")), F.lit(0.0)) * budget)
    out = scale_to_target_vol(weighted, target_vol, scope, bound)
    return out.select(*scope, "ts", "asset", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def gross_limit(weights: DataFrame, limit: float, scope: list[str] | None = None, bound: int | None = None) -> DataFrame:
    """Scale each date down to ``sum |w| <= limit``."""
    if limit <= 0:
        raise ValueError(f"a gross limit of {limit} leaves nothing to hold")
    sized = totals_within(weights, [*(scope or []), "ts"], {"_gross": F.sum(F.abs("weight"))}, bound)
    scale = F.least(F.lit(1.0), F.coalesce(ratio(F.lit(limit), F.col("_gross")), F.lit(1.0)))
    return sized.withColumn("weight", F.col("weight") * scale).drop("_gross")


def net_limit(weights: DataFrame, limit: float, scope: list[str] | None = None, bound: int | None = None) -> DataFrame:
    """Bring ``|sum w|`` down to the limit by cutting the largest same-sign weights first.

    Each weight gives up what the larger ones before it left over. Equal weights: later asset first.
    """
    if limit < 0:
        raise ValueError(f"a net limit of {limit} cannot be met")
    if limit == float("inf"):
        return weights
    by = [*(scope or []), "ts"]
    netted = totals_within(weights, by, {"_net": F.sum("weight")}, bound)
    side = F.when(F.col("_net") > 0, 1.0).otherwise(-1.0)
    excess = F.greatest(F.abs("_net") - F.lit(float(limit)), F.lit(0.0))
    # only dates over the limit are sorted
    give = netted.withColumn("_excess", excess).withColumn(
        "_give", F.when((F.col("_excess") > 0) & (F.col("weight") * side > 0), F.abs("weight"))
    )
    placed = order_within(give, by, "_give", "asset", "_place", before="_before", ascending=False, bound=bound)
    cut = F.least(F.greatest(F.col("_excess") - F.col("_before"), F.lit(0.0)), F.col("_give"))
    return placed.withColumn("weight", F.when(F.col("_give").isNotNull(), F.col("weight") - side * cut).otherwise(F.col("weight"))).drop(
        "_net", "_excess", "_give", "_place", "_before"
    )


def trades(weights: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Weight change per row; the first row trades the whole weight."""
    w = F.col("weight")
    return with_windows(
        weights, [*(scope or []), "asset"], lambda win: {"trade": w - F.coalesce(F.lag(w, 1).over(win), F.lit(0.0))}, before=1
    )


def construct_portfolio(
    signals: DataFrame, prices: DataFrame, classes: DataFrame | None = None, sizing_method: str = "vol_target",
    target_vol: float = 0.10, gross: float = 2.0, net: float = 0.20, vol_window: int = 60,
    scope: list[str] | None = None, bound: int | None = None, strict: bool = False,
) -> DataFrame:
    """Sizing, gross limit, net limit, trades: ``(scope, ts, asset, weight, trade)``."""
    method = str(sizing_method).lower().strip()
    if method == "vol_target":
        sized = vol_target_weights(signals, prices, target_vol, vol_window, scope, bound, strict)
    elif method == "risk_parity":
        sized = risk_parity_weights(signals, prices, classes, target_vol, vol_window, scope, bound, strict)
    else:
        raise ValueError("unknown sizing_method: vol_target and risk_parity exist")
    return trades(net_limit(gross_limit(sized, gross, scope, bound), net, scope, bound), scope)


def spread_lookup(
    df: DataFrame, spreads: DataFrame | None = None, fx: float = FX_SPREAD_BPS,
    treasury: float = TREASURY_ETF_SPREAD_BPS, equity: float = EQUITY_SPREAD_BPS,
) -> DataFrame:
    """Add ``spread_bps``: the instrument's own entry in ``spreads(asset, spread_bps)``, else the
    default of its kind."""
    kind = (
        F.when(F.col("asset").contains("/"), F.lit(fx))
        .when(F.col("asset").isin(*TREASURY_ETFS), F.lit(treasury))
        .otherwise(F.lit(equity))
    )
    if spreads is None:
        return df.withColumn("spread_bps", kind)
    own = spreads.select("asset", F.col("spread_bps").alias("_own"))
    return df.join(own, "asset", "left").withColumn("spread_bps", F.coalesce(F.col("_own"), kind)).drop("_own")


def trade_cost_bps(
    size: Column, adv: Column, spread_bps: Column, model: str = "linear", coefficient: float = DEFAULT_IMPACT_COEFFICIENT
) -> Column:
    """Spread plus market impact of one trade; no trade costs nothing, adv must be positive."""
    if model not in ("linear", "sqrt"):
        raise ValueError(f"unknown impact model {model!r}: linear and sqrt exist")
    share = F.abs(size) / adv
    impact = F.lit(coefficient) * (share if model == "linear" else F.sqrt(share))
    refused = F.raise_error(F.lit("adv must be > 0 for non-zero trades.")).cast("double")
    return F.when(size == 0, F.lit(0.0)).when(adv <= 0, refused).otherwise(spread_bps + impact)


def apply_costs(
    gross: DataFrame, traded: DataFrame, spreads: DataFrame | None = None, model: str = "linear",
    coefficient: float = DEFAULT_IMPACT_COEFFICIENT, scope: list[str] | None = None,
) -> DataFrame:
    """``(scope, ts, gross)`` and trades to ``net`` = gross - costs of the date's non-zero trades.

    Trades count as participation (adv 1), and every non-zero trade pays its full spread.
    """
    on = [*(scope or []), "ts"]
    priced = spread_lookup(traded.filter(F.col("trade") != 0), spreads)
    cost = trade_cost_bps(F.col("trade"), F.lit(1.0), F.col("spread_bps"), model, coefficient)
    costs = priced.groupBy(*on).agg(F.sum(cost).alias("cost_bps"))
    return gross.join(costs, on, "left").withColumn(
        "net", F.col("gross") - F.coalesce(F.col("cost_bps"), F.lit(0.0)) / 10000
    ).drop("cost_bps")
