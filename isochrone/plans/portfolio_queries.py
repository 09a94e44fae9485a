"""Sizing, limits, costs, out-of-sample returns, folds and report tables.

The universe is the nation dimension; monthly average order values serve as prices and regions as
asset classes.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import folds as FD
from ..operators import panel as P
from ..operators import portfolio as W
from ..operators import reports as RP
from ..operators import signals as G
from ..operators.series import with_windows
from . import panels as S
from .panels import ctes, div_sql, edge, ln_sql, rank_sql, rnd_sql, sday
from .registry import query

VOL_WINDOW, TARGET, GROSS, NET = 6, 0.10, 2.0, 0.20
TRAIN, TEST = 36, 12
N_GROUPS, K_TEST = 10, 2
REFERENCE = "NATION_0"


# --- inputs -----------------------------------------------------------------------------------

def bound(spark, sf):
    return S.universe(spark, sf, "nation")


def prices(spark, sf):
    return P.price_panel(S.nation_m(spark, sf))


def rank_signal(prices_df, scope=None, limit=None):
    """Cross-sectional rank of last month's price."""
    scope = scope or []
    lagged = with_windows(prices_df, [*scope, "asset"], lambda w: {"value": F.lag("value", 1).over(w)}, before=1)
    return G.normalise_rank(P.dense_panel(lagged, scope=scope), [*scope, "ts"], limit)


def book(spark, sf, method="vol_target"):
    px, n = prices(spark, sf), bound(spark, sf)
    classes = S.nation_classes(spark, sf) if method == "risk_parity" else None
    return W.construct_portfolio(rank_signal(px, limit=n), px, classes, method, TARGET, GROSS, NET, VOL_WINDOW, bound=n)


def spreads(spark, sf):
    return S.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("asset"), F.lit(3.0).alias("spread_bps"))


CONFIG = {"sizing_method": "vol_target", "target_vol": TARGET, "gross": GROSS, "net": NET, "vol_window": VOL_WINDOW}


def days_and_trades(spark, sf, reference_asset=None, source=None, scope=None):
    n = bound(spark, sf)
    px = S.nation_m(spark, sf) if source is None else source
    return B.backtest_days(lambda p: rank_signal(p, scope, n), px, None, CONFIG, reference_asset, spreads(spark, sf), scope, n)


@S._stored
def nation_days(spark, sf):
    """Monthly gross and net returns of the rank portfolio, kept for the report queries."""
    return days_and_trades(spark, sf)[0]


# --- the same in SQL --------------------------------------------------------------------------

def over(part, order="ts", rows="UNBOUNDED PRECEDING"):
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS {rows})"


def price_steps(src="nation_m", scope="", out="np"):
    """Dense, carried-forward price panel of ``src`` (``scope``: extra key with trailing comma)."""
    s = scope.rstrip(", ")
    cal = f"(SELECT DISTINCT {scope} ts FROM {src}) c JOIN (SELECT DISTINCT {scope} asset FROM {src}) a " + (f"ON a.{s} = c.{s}" if s else "ON true")
    cols = f"c.{s}, " if s else ""
    on = f"AND p.{s} = c.{s}" if s else ""
    return [(f"{out}0", f"SELECT {cols} c.ts, a.asset, p.value FROM {cal} LEFT JOIN {src} p ON p.ts = c.ts AND p.asset = a.asset {on}"),
        (out, f"SELECT {scope} ts, asset, nullif(last_value(value IGNORE NULLS) {over(scope + ' asset')}, 0) AS value FROM {out}0")]


def signal_steps(src="np", scope="", out="ns", raw=None):
    """Rank of the lagged price of ``raw`` on its dense panel; missing stays missing."""
    return [(f"{out}l", f"SELECT {scope} ts, asset, lag(value) {over(scope + ' asset', rows='UNBOUNDED PRECEDING').replace(' ROWS UNBOUNDED PRECEDING', '')} AS v FROM {src}"),
        (f"{out}r", f"SELECT {scope} ts, asset, {rank_sql(scope + ' ts', 'v')} / count(*) OVER (PARTITION BY {scope} ts) * 2 - 1 AS value FROM {out}l WHERE v IS NOT NULL"),
        (out, f"SELECT l.*, r.value FROM {out}l l LEFT JOIN {out}r r USING ({scope} ts, asset)")]


def vol_steps(sig="ns", px="np", scope="", out="nv", fill=False):
    signal = "coalesce(s.value, 0)" if fill else "s.value"
    s = scope.rstrip(", ")
    key = f"s.{s}, " if s else ""
    r = f"{ln_sql('value')} - {ln_sql(f'lag(value) OVER (PARTITION BY {scope} asset ORDER BY ts)')}"
    return [(f"{out}r", f"SELECT *, {r} AS r FROM {px}"),
        (f"{out}w", f"SELECT *, CASE WHEN count(r) OVER w = {VOL_WINDOW} THEN stddev_samp(r) OVER w * sqrt(252) END AS v FROM {out}r WINDOW w AS (PARTITION BY {scope} asset ORDER BY ts ROWS {VOL_WINDOW - 1} PRECEDING)"),
        (f"{out}f", f"SELECT *, last_value(v IGNORE NULLS) {over(scope + ' asset')} AS vol FROM {out}w"),
        (out, f"SELECT {key} s.ts, s.asset, {signal} AS signal, f.vol FROM {sig} s JOIN {out}f f ON f.ts = s.ts AND f.asset = s.asset " + (f"AND f.{s} = s.{s}" if s else ""))]


def scale_steps(src, scope="", out="sw"):
    return [(f"{out}r", f"SELECT *, sqrt(sum(power(coalesce(weight, 0) * coalesce(vol, 0), 2)) OVER (PARTITION BY {scope} ts)) AS risk FROM {src}"),
        (out, f"SELECT * EXCLUDE (weight, risk), coalesce(weight, 0) * coalesce({div_sql(str(TARGET), 'risk')}, 0) AS weight FROM {out}r")]


def target_steps(scope=""):
    return [("vt", f"SELECT *, signal * {div_sql(str(TARGET), 'vol')} AS weight FROM nv"), *scale_steps("vt", scope)]


def parity_steps():
    return [("nation_classes", S.PANEL_SQL["nation_classes"]), ("rp0", f"SELECT v.*, c.cls, {div_sql('signal', 'vol')} AS raw FROM nv v JOIN nation_classes c ON c.asset = v.asset"),
        ("rp1", "SELECT *, sum(abs(raw)) OVER (PARTITION BY ts, cls) AS g FROM rp0"),
        ("rp", f"SELECT *, coalesce({div_sql('raw', 'g')}, 0) / (SELECT count(DISTINCT cls) FROM nation_classes) AS weight FROM rp1"), *scale_steps("rp")]


def limit_steps(src="sw", scope=""):
    return [("gl0", f"SELECT *, sum(abs(weight)) OVER (PARTITION BY {scope} ts) AS g FROM {src}"),
        ("gl", f"SELECT * EXCLUDE (weight, g), weight * least(1, coalesce({div_sql(str(GROSS), 'g')}, 1)) AS weight FROM gl0"),
        ("nl0", f"SELECT *, sum(weight) OVER (PARTITION BY {scope} ts) AS net FROM gl"),
        ("nl1", f"SELECT *, CASE WHEN net > 0 THEN 1.0 ELSE -1.0 END AS side, greatest(abs(net) - {NET}, 0) AS excess FROM nl0"),
        ("nl2", "SELECT *, CASE WHEN excess > 0 AND weight * side > 0 THEN abs(weight) END AS give FROM nl1"),
        ("nl3", f"SELECT *, coalesce(sum(give) OVER (PARTITION BY {scope} ts ORDER BY give DESC NULLS LAST, asset DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM nl2"),
        ("nl", f"SELECT {scope} ts, asset, CASE WHEN give IS NULL THEN weight ELSE weight - side * least(greatest(excess - bef, 0), give) END AS weight FROM nl3"),
        ("bk", f"SELECT *, weight - coalesce(lag(weight) OVER (PARTITION BY {scope} asset ORDER BY ts), 0) AS trade FROM nl")]


def cost_steps(scope=""):
    cost = "CASE WHEN n_regionkey = 1 THEN 3.0 ELSE 5.0 END + 10 * abs(trade)"
    return [("co", f"SELECT {scope} ts, sum({cost}) AS bps FROM bk JOIN nation ON n_name = asset WHERE trade <> 0 GROUP BY {scope} ts")]


def gross_steps(reference=None, scope=""):
    s = scope.rstrip(", ")
    eq = f"AND f.{s} = b.{s}" if s else ""
    key = f"b.{s}, " if s else ""
    fwd = [("fr", f"SELECT *, {ln_sql(f'lead(value) OVER (PARTITION BY {scope} asset ORDER BY ts)')} - {ln_sql('value')} AS fwd FROM np")]
    if reference:
        return [*fwd, ("gr", f"SELECT {key} b.ts, sum(b.weight) * max(f.fwd) AS gross FROM bk b LEFT JOIN fr f ON f.ts = b.ts AND f.asset = '{reference}' {eq} GROUP BY {key} b.ts")]
    return [*fwd, ("gr", f"SELECT {key} b.ts, sum(b.weight * f.fwd) AS gross FROM bk b LEFT JOIN fr f ON f.ts = b.ts AND f.asset = b.asset {eq} GROUP BY {key} b.ts")]


def days_steps(reference=None, scope="", src="nation_m"):
    """Backtest days: gross, net and trades (the signal is sampled as of each date, missing = 0)."""
    s = scope.rstrip(", ")
    eq = f"AND c.{s} = g.{s}" if s else ""
    key = f"g.{s}, " if s else ""
    # the signal works on the raw rows of src made dense after the lag
    lag = [("nsl", f"SELECT {scope} ts, asset, lag(value) OVER (PARTITION BY {scope} asset ORDER BY ts) AS v FROM {src}"),
        ("nsr", f"SELECT {scope} ts, asset, {rank_sql(scope + ' ts', 'v')} / count(*) OVER (PARTITION BY {scope} ts) * 2 - 1 AS value FROM nsl WHERE v IS NOT NULL"),
        ("ns", f"SELECT p.*EXCLUDE (value), r.value FROM np p LEFT JOIN nsr r USING ({scope} ts, asset)")]
    return [*price_steps(src, scope), *lag, *vol_steps(scope=scope, fill=True), *target_steps(scope), *limit_steps(scope=scope), *cost_steps(scope), *gross_steps(reference, scope),
        ("dy", f"SELECT g.*, g.gross - coalesce(c.bps, 0) / 10000 AS net FROM gr g LEFT JOIN co c ON c.ts = g.ts {eq}")]


def stats_steps(src="dy", key="run", traded="bk"):
    """Statistics per ``key`` of ``src(key, ts, gross, net)``."""
    return [
        ("st0", f"SELECT {key}, ts, gross, coalesce(net, 0) AS net, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS i FROM {src}"),
        ("st1", f"SELECT *, product(1 + net) {over(key)} AS wealth FROM st0"), ("st2", f"SELECT *, max(wealth) {over(key)} AS peak FROM st1"),
        ("st3", "SELECT *, wealth / peak - 1 AS dd FROM st2"),
        ("tr", f"SELECT {key}, min(dd) AS mdd, arg_min(i, (dd, i)) AS ti, arg_min(peak, (dd, i)) AS tp, max(i) AS li, count(*) AS rows_ FROM st3 GROUP BY 1"),
        ("ep", f"SELECT t.{key}, mdd, li, rows_, max(i) FILTER (i <= ti AND abs(wealth - tp) <= 1e-9 * greatest(1, abs(tp))) AS si, min(i) FILTER (i > ti AND wealth >= tp - 1e-12) AS ri FROM st3 s JOIN tr t ON s.{key} = t.{key} GROUP BY 1, 2, 3, 4"),
        ("du", f"SELECT {key}, mdd, CASE WHEN rows_ < 2 OR mdd >= -1e-15 THEN 0 ELSE coalesce(ri, li) - coalesce(si, 1) END AS dur FROM ep"),
        ("ag", f"SELECT {key}, count(*) AS n, avg(net) AS m, stddev_samp(net) AS sd, stddev_samp(least(net, 0)) AS dn, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM st0 GROUP BY 1"),
        ("stats", f"SELECT ag.{key}, {rnd_sql('CASE WHEN n >= 2 THEN m * 252 END')} AS annualised_return, {rnd_sql('sd * sqrt(252)')} AS annualised_vol, {rnd_sql(div_sql('m', 'sd') + ' * sqrt(252)')} AS sharpe_ratio, "
            f"{rnd_sql(div_sql('m', 'dn') + ' * sqrt(252)')} AS sortino_ratio, {rnd_sql('mdd')} AS max_drawdown, CAST(dur AS INTEGER) AS max_drawdown_duration, "
            f"{rnd_sql('CASE WHEN mdd < -1e-15 AND n >= 2 THEN m * 252 / abs(mdd) END')} AS calmar_ratio, {rnd_sql('hit')} AS hit_rate FROM ag JOIN du ON ag.{key} = du.{key}"),
    ]


def trade_stats_steps(src="dy", key="run", traded="bk"):
    return [("mv", f"SELECT {key}, ts, sum(abs(trade)) AS moved FROM {traded} GROUP BY 1, 2"),
        ("tstats", f"SELECT d.{key}, {rnd_sql('avg(gross) FILTER (moved > 0)')} AS avg_trade_return, {rnd_sql('coalesce(sum((gross - coalesce(net, 0)) * 10000), 0)', 4)} AS total_cost_bps, {rnd_sql('avg(coalesce(moved, 0)) * 252')} AS turnover_annual "
                   f"FROM {src} d LEFT JOIN mv ON mv.{key} = d.{key} AND mv.ts = d.ts GROUP BY 1")]


PANEL = ["nation_m", *price_steps(), *signal_steps()]
SIZED = [*PANEL, *vol_steps()]


# --- sizing and limits ------------------------------------------------------------------------

@query("realised_vol", ctes(*SIZED) + f"SELECT {sday()}, asset, {rnd_sql('vol')} AS vol FROM nvf")
def realised_vol(spark, sf):
    return edge(W.realised_vol(prices(spark, sf), VOL_WINDOW), "ts", "asset", "vol")


@query("vol_target_weights", ctes(*SIZED, *target_steps()) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight FROM sw")
def vol_target_weights(spark, sf):
    px, n = prices(spark, sf), bound(spark, sf)
    return edge(W.vol_target_weights(rank_signal(px, limit=n), px, TARGET, VOL_WINDOW, bound=n))


@query("scale_to_target_vol", ctes(*SIZED, ("raw", "SELECT ts, asset, signal AS weight, vol FROM nv"), *scale_steps("raw")) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight FROM sw")
def scale_to_target_vol(spark, sf):
    px, n = prices(spark, sf), bound(spark, sf)
    vol = W.realised_vol(px, VOL_WINDOW).select("ts", "asset", "vol")
    raw = rank_signal(px, limit=n).withColumnRenamed("value", "weight").join(vol, ["ts", "asset"])
    return edge(W.scale_to_target_vol(raw, TARGET), "ts", "asset", "weight")


@query("risk_parity_weights", ctes(*SIZED, *parity_steps()) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight FROM sw")
def risk_parity_weights(spark, sf):
    px, n = prices(spark, sf), bound(spark, sf)
    return edge(W.risk_parity_weights(rank_signal(px, limit=n), px, S.nation_classes(spark, sf), TARGET, VOL_WINDOW, bound=n))


_RAW_W = ("sw", "SELECT ts, asset, coalesce(signal, 0) AS weight FROM nv")


def _raw_weights(spark, sf):
    px = prices(spark, sf)
    return rank_signal(px, limit=bound(spark, sf)).select("ts", "asset", F.coalesce("value", F.lit(0.0)).alias("weight"))


@query("gross_limit", ctes(*SIZED, _RAW_W, *limit_steps()) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight FROM gl")
def gross_limit(spark, sf):
    return edge(W.gross_limit(_raw_weights(spark, sf), GROSS, bound=bound(spark, sf)), "ts", "asset", "weight")


@query("net_limit", ctes(*SIZED, ("sw", "SELECT ts, asset, CASE WHEN signal > -0.5 THEN signal ELSE 0.0 END AS weight FROM nv"), *limit_steps()) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight FROM nl")
def net_limit(spark, sf):
    n = bound(spark, sf)
    raw = _raw_weights(spark, sf).withColumn("weight", F.when(F.col("weight") > -0.5, F.col("weight")).otherwise(0.0))
    return edge(W.net_limit(W.gross_limit(raw, GROSS, bound=n), NET, bound=n), "ts", "asset", "weight")


@query("net_limit_unbounded", ctes(*SIZED, ("sw", "SELECT ts, asset, CASE WHEN signal > -0.5 THEN signal ELSE 0.0 END AS weight FROM nv"), *limit_steps()) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight FROM nl")
def net_limit_unbounded(spark, sf):
    """The greedy cut with two-level ordering, for universes without a known bound."""
    raw = _raw_weights(spark, sf).withColumn("weight", F.when(F.col("weight") > -0.5, F.col("weight")).otherwise(0.0))
    return edge(W.net_limit(W.gross_limit(raw, GROSS), NET), "ts", "asset", "weight")


@query("trades", ctes(*SIZED, *target_steps(), *limit_steps()) + f"SELECT {sday()}, asset, {rnd_sql('trade')} AS trade FROM bk")
def trades(spark, sf):
    return edge(book(spark, sf), "ts", "asset", "trade")


@query("construct_portfolio", ctes(*SIZED, *parity_steps(), *limit_steps()) + f"SELECT {sday()}, asset, {rnd_sql('weight')} AS weight, {rnd_sql('trade')} AS trade FROM bk")
def construct_portfolio(spark, sf):
    return edge(book(spark, sf, "risk_parity"))


# --- costs ------------------------------------------------------------------------------------

_INSTR = "CASE WHEN n_regionkey = 0 THEN n_name || '/USD' WHEN n_nationkey = 1 THEN 'TLT' ELSE n_name END"


@query("spread_lookup", f"SELECT {_INSTR} AS asset, CASE WHEN n_regionkey = 2 THEN 3.25 WHEN n_regionkey = 0 THEN 1.5 WHEN n_nationkey = 1 THEN 2.0 ELSE 5.0 END::DOUBLE AS spread_bps FROM nation")
def spread_lookup(spark, sf):
    nation = S.table(spark, sf, "nation")
    named = nation.select(F.expr(_INSTR).alias("asset"), "n_regionkey")
    own = named.filter("n_regionkey = 2").select("asset", F.lit(3.25).alias("spread_bps"))
    return edge(W.spread_lookup(named.select("asset"), own))


@query("trade_cost_bps", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 5 THEN 0 ELSE 5 + 10 * (l_quantity - 5) / 50 END, 6) + 0.0 AS linear_bps, "
    "round(CASE WHEN l_quantity <= 5 THEN 0 ELSE 2 + 8 * sqrt((l_quantity - 5) / 50) END, 6) + 0.0 AS sqrt_bps FROM lineitem")
def trade_cost_bps(spark, sf):
    size = F.greatest(F.col("l_quantity") - 5, F.lit(0.0))
    li = S.table(spark, sf, "lineitem")
    return edge(li.select("l_orderkey", "l_linenumber", W.trade_cost_bps(size, F.lit(50.0), F.lit(5.0)).alias("linear_bps"),
        W.trade_cost_bps(-size, F.lit(50.0), F.lit(2.0), "sqrt", 8.0).alias("sqrt_bps")))


@query("apply_costs", ctes("nation_m", *days_steps()) + f"SELECT {sday()}, {rnd_sql('gross')} AS gross, {rnd_sql('net')} AS net FROM dy")
def apply_costs(spark, sf):
    return edge(days_and_trades(spark, sf)[0])


# --- returns and statistics -------------------------------------------------------------------

@query("portfolio_returns", ctes(*SIZED, *target_steps(), *limit_steps(), *gross_steps()) + f"SELECT {sday()}, {rnd_sql('gross')} AS gross FROM gr")
def portfolio_returns(spark, sf):
    return edge(B.portfolio_returns(book(spark, sf), prices(spark, sf)))


@query("portfolio_returns_one_asset", ctes(*SIZED, *target_steps(), *limit_steps(), *gross_steps(REFERENCE)) + f"SELECT {sday()}, {rnd_sql('gross')} AS gross FROM gr")
def portfolio_returns_one_asset(spark, sf):
    """The whole net weight priced on one reference instrument."""
    return edge(B.portfolio_returns(book(spark, sf), prices(spark, sf), REFERENCE))


# per-supplier monthly returns: as many return series as suppliers
_SUPP_RET = ["supp_m", ("dy", f"SELECT asset AS run, ts, value / 1e4 AS gross, {div_sql('value', 'lag(value) OVER (PARTITION BY asset ORDER BY ts)')} / 10 - 0.1 AS net FROM supp_m")]


def supplier_returns(spark, sf):
    """A tenth of each supplier's monthly price change as a return series (first month missing)."""
    return with_windows(S.supp_m(spark, sf), ["asset"], lambda w: {"net": F.try_divide(F.col("value"), F.lag("value", 1).over(w)) / 10 - 0.1}, before=1).select(
        F.col("asset").alias("run"), "ts", (F.col("value") / 1e4).alias("gross"), "net")


_STAT_COLS = "annualised_return annualised_vol sharpe_ratio sortino_ratio max_drawdown max_drawdown_duration calmar_ratio hit_rate".split()


@query("return_stats", ctes(*_SUPP_RET, *stats_steps()) + "SELECT run, " + ", ".join(_STAT_COLS) + " FROM stats")
def return_stats(spark, sf):
    return edge(B.return_stats(supplier_returns(spark, sf), ["run"]))


@query("trade_stats", ctes("nation_m", *days_steps(), ("d1", "SELECT 1 AS run, * FROM dy"), ("b1", "SELECT 1 AS run, * FROM bk"), *trade_stats_steps("d1", "run", "b1")) + "SELECT * FROM tstats")
def trade_stats(spark, sf):
    days, traded = days_and_trades(spark, sf)
    out = B.trade_stats(days.withColumn("run", F.lit(1)), traded.withColumn("run", F.lit(1)), ["run"])
    return edge(out.withColumn("total_cost_bps", F.round("total_cost_bps", 4)))


@query("avg_sharpe_clean", ctes(*_SUPP_RET) + f"SELECT run, CASE WHEN count(net) < 2 THEN NULL WHEN stddev_samp(net) = 0 THEN '-inf'::DOUBLE ELSE {rnd_sql(div_sql('avg(net)', 'stddev_samp(net)') + ' * sqrt(252)')} END AS sharpe FROM dy GROUP BY 1")
def avg_sharpe_clean(spark, sf):
    return edge(B.avg_sharpe_clean(supplier_returns(spark, sf), ["run"], "net"))


@query("cum_returns", ctes(*_SUPP_RET, ("k", "SELECT run, coalesce(median(abs(net)), 0) < 0.5 AS simple FROM dy GROUP BY 1"),
    ("c", f"SELECT d.run, ts, simple, product(1 + coalesce(net, 0)) OVER w AS p, sum(coalesce(net, 0)) OVER w AS s FROM dy d JOIN k ON k.run = d.run WINDOW w AS (PARTITION BY d.run ORDER BY ts ROWS UNBOUNDED PRECEDING)")) +
    f"SELECT run, {sday()}, round(CASE WHEN simple THEN p - 1 ELSE exp(s) - 1 END, 6) + 0.0 AS cum_return FROM c")
def cum_returns(spark, sf):
    return edge(B.cum_returns(supplier_returns(spark, sf), ["run"], "net"))


@query("drawdown", ctes(*_SUPP_RET, *stats_steps()) + f"SELECT run, {sday()}, {rnd_sql('wealth')} AS wealth, {rnd_sql('dd')} AS drawdown FROM st3")
def drawdown(spark, sf):
    return edge(B.drawdown(supplier_returns(spark, sf), ["run"]), "run", "ts", "wealth", "drawdown")


@query("drawdown_duration", ctes(*_SUPP_RET, ("d2", "SELECT * FROM dy WHERE net IS NOT NULL"), *stats_steps("d2")) + "SELECT run, max_drawdown, max_drawdown_duration FROM stats")
def drawdown_duration(spark, sf):
    return edge(B.drawdown_duration(supplier_returns(spark, sf), ["run"]))


@query("rolling_sharpe", ctes(*_SUPP_RET) + f"SELECT run, {sday()}, CASE WHEN count(net) OVER w >= 20 THEN round({div_sql('avg(net) OVER w', 'stddev_samp(net) OVER w')} * sqrt(252), 6) + 0.0 END AS rolling_sharpe FROM dy WINDOW w AS (PARTITION BY run ORDER BY ts ROWS 251 PRECEDING)")
def rolling_sharpe(spark, sf):
    return edge(B.rolling_sharpe(supplier_returns(spark, sf), ["run"]), "run", "ts", "rolling_sharpe")


_ALL_STATS = ", ".join([*_STAT_COLS, "avg_trade_return", "total_cost_bps", "turnover_annual"])


def _rounded(df):
    return edge(df.withColumn("total_cost_bps", F.round("total_cost_bps", 4)))


def _test_days(rows):
    return [("td", f"SELECT DISTINCT ts FROM dy ORDER BY ts DESC LIMIT {rows}"), ("d1", "SELECT 1 AS run, * FROM dy WHERE ts IN (SELECT ts FROM td)"), ("b1", "SELECT 1 AS run, * FROM bk WHERE ts IN (SELECT ts FROM td)")]


@query("backtest", ctes("nation_m", *days_steps(REFERENCE), *_test_days(TEST * 2), *stats_steps("d1"), *trade_stats_steps("d1", "run", "b1")) + f"SELECT run, {_ALL_STATS} FROM stats JOIN tstats USING (run)")
def backtest(spark, sf):
    days, traded = days_and_trades(spark, sf, REFERENCE)
    days, traded = B.backtest(days, traded, TRAIN, TEST * 2)
    return _rounded(B.backtest_result(days.withColumn("run", F.lit(1)), traded.withColumn("run", F.lit(1)), ["run"]))


# --- folds ------------------------------------------------------------------------------------

_FOLD_CAL = [("ca", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM nation_m)"),
    ("fo", f"SELECT unnest(range(0, (SELECT (max(n) - {TRAIN}) // {TEST} FROM ca))) AS fold")]


@query("walk_forward_expanding", ctes("nation_m", *days_steps(), *_FOLD_CAL, ("te", f"SELECT fold, ts FROM fo JOIN ca ON i >= {TRAIN} + fold * {TEST} AND i < {TRAIN} + (fold + 1) * {TEST}"),
    ("d1", "SELECT te.fold AS run, dy.* FROM te JOIN dy ON dy.ts = te.ts"), ("b1", "SELECT te.fold AS run, bk.* FROM te JOIN bk ON bk.ts = te.ts"),
    *stats_steps("d1"), *trade_stats_steps("d1", "run", "b1"), ("tc", f"SELECT fold AS run, {TRAIN} + fold * {TEST} AS train_rows FROM fo")) +
    f"SELECT CAST(run AS INTEGER) AS fold, CAST(train_rows AS BIGINT) AS train_rows, {_ALL_STATS} FROM stats JOIN tstats USING (run) JOIN tc USING (run)")
def walk_forward_expanding(spark, sf):
    days, traded = days_and_trades(spark, sf)
    folds = FD.walk_forward_folds(S.nation_m(spark, sf), TRAIN, TEST)
    test = folds.filter("is_test").select("fold", "ts")
    train = folds.filter("not is_test").groupBy("fold").agg(F.count(F.lit(1)).alias("train_rows"))
    return _rounded(B.backtest_result(days.join(test, "ts"), traded.join(test, "ts"), ["fold"]).join(train, "fold"))


# A fold's own last test date has no forward return: prices after the fold are not visible.
_ROLL_SRC = [*_FOLD_CAL, ("src", f"SELECT CAST(fold AS INTEGER) AS fold, m.ts, m.asset, m.value FROM fo JOIN ca ON i >= fold * {TEST} AND i < fold * {TEST} + {TRAIN + TEST} JOIN nation_m m ON m.ts = ca.ts")]


def rolling_days_steps():
    """Per fold: the signal sees only the last TRAIN rows of each series inside the fold."""
    steps = dict(days_steps(scope="fold, ", src="src"))
    steps["nsl0"] = f"SELECT *, row_number() OVER (PARTITION BY fold, asset ORDER BY ts DESC) AS b FROM src"
    steps["nsl"] = f"SELECT fold, ts, asset, lag(value) OVER (PARTITION BY fold, asset ORDER BY ts) AS v FROM nsl0 WHERE b <= {TRAIN}"
    # a date before the first sliced signal row has no signal yet
    order = ["np0", "np", "nsl0", "nsl", *[k for k in steps if k not in ("np0", "np", "nsl0", "nsl")]]
    return [(k, steps[k]) for k in order]


@query("walk_forward_rolling", ctes("nation_m", *_ROLL_SRC, *rolling_days_steps(), ("te", f"SELECT CAST(fold AS INTEGER) AS fold, ts FROM fo JOIN ca ON i >= {TRAIN} + fold * {TEST} AND i < {TRAIN} + (fold + 1) * {TEST}"),
    ("d1", "SELECT dy.* FROM te JOIN dy ON dy.ts = te.ts AND dy.fold = te.fold"), ("b1", "SELECT bk.* FROM te JOIN bk ON bk.ts = te.ts AND bk.fold = te.fold"),
    *stats_steps("d1", "fold"), *trade_stats_steps("d1", "fold", "b1")) + f"SELECT fold, {_ALL_STATS} FROM stats JOIN tstats USING (fold)")
def walk_forward_rolling(spark, sf):
    n = bound(spark, sf)
    folds = FD.walk_forward_folds(S.nation_m(spark, sf), TRAIN, TEST, "rolling")
    source = S.nation_m(spark, sf).join(folds, "ts").select("fold", "ts", "asset", "value")

    def signal(px):
        back = F.row_number().over(Window.partitionBy("fold", "asset").orderBy(F.desc("ts")))
        seen = px.withColumn("_back", back).filter(F.col("_back") <= TRAIN).drop("_back")
        return rank_signal(seen, ["fold"], n)

    days, traded = B.backtest_days(signal, source, None, CONFIG, None, spreads(spark, sf), ["fold"], n)
    test = folds.filter("is_test").select("fold", "ts")
    return _rounded(B.backtest_result(days.join(test, ["fold", "ts"]), traded.join(test, ["fold", "ts"]), ["fold"]))


def cpcv_steps(n_groups=N_GROUPS, k=K_TEST):
    combos = " UNION ALL ".join(f"SELECT {p} AS path, {g} AS grp" for p, c in enumerate(_combos(n_groups, k)) for g in c)
    base, rest = "((n - 1) // {g})".format(g=n_groups), "((n - 1) % {g})".format(g=n_groups)
    return [("ca", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM nation_m)"),
        ("gp", f"SELECT ts, i, CASE WHEN i = 0 THEN NULL WHEN i - 1 < {rest} * ({base} + 1) THEN (i - 1) // ({base} + 1) ELSE {rest} + (i - 1 - {rest} * ({base} + 1)) // {base} END AS grp FROM ca"),
        ("cb", combos), ("pa", "SELECT DISTINCT path FROM cb"),
        ("fo", "SELECT p.path, g.ts, g.i, c.grp IS NOT NULL AS is_test FROM pa p CROSS JOIN gp g LEFT JOIN cb c ON c.path = p.path AND c.grp = g.grp")]


def _combos(n_groups, k, limit=None):
    return list(itertools.islice(itertools.combinations(range(n_groups), k), limit))


@query("cpcv_folds", ctes("nation_m", *cpcv_steps(12, 3)) + f"SELECT CAST(path AS INTEGER) AS path, {sday()}, is_test FROM fo")
def cpcv_folds(spark, sf):
    return edge(FD.cpcv_folds(S.nation_m(spark, sf), 12, 3), "path", "ts", "is_test")


def cpcv_path_steps():
    oos = [("d1", "SELECT f.path AS run, dy.* FROM fo f JOIN dy ON dy.ts = f.ts WHERE f.is_test"),
        ("oo", f"SELECT run AS path, {div_sql('avg(coalesce(net, 0))', 'stddev_samp(coalesce(net, 0))')} * sqrt(252) AS oos_sharpe FROM d1 GROUP BY 1")]
    full = _renamed(days_steps(), "o_")
    train = [("tn", "SELECT path, ts, row_number() OVER (PARTITION BY path ORDER BY ts DESC) AS b, count(*) OVER (PARTITION BY path) AS k FROM fo WHERE NOT is_test"),
        ("trs", "SELECT t.path, m.ts, m.asset, m.value FROM tn t JOIN nation_m m ON m.ts = t.ts WHERE t.k >= 8")]
    ins = _renamed(days_steps(scope="path, ", src="trs"), "i_")
    tail = [("ii", f"SELECT d.path, {div_sql('avg(coalesce(d.net, 0))', 'stddev_samp(coalesce(d.net, 0))')} * sqrt(252) AS is_sharpe FROM i_dy d JOIN tn t ON t.path = d.path AND t.ts = d.ts WHERE t.b <= greatest(2, least(20, t.k // 2)) GROUP BY 1")]
    return [*cpcv_steps(), *full, *oos, *train, *ins, *tail,
        ("cp", "SELECT p.path, oos_sharpe, is_sharpe FROM pa p LEFT JOIN oo USING (path) LEFT JOIN ii USING (path)")]


def _renamed(steps, prefix):
    """The steps with their own names prefixed, so two copies fit into one query."""
    names = [k for k, _ in steps]
    pattern = re.compile(r"(?<=FROM )(" + "|".join(names) + r")\b|(?<=JOIN )(" + "|".join(names) + r")\b")
    out = [(f"{prefix}{k}", pattern.sub(lambda m: prefix + m.group(0), v)) for k, v in steps]
    return [("dy" if prefix == "o_" and k == "o_dy" else k, v) for k, v in out]


def cpcv_table(spark, sf):
    """Out-of-sample and in-sample Sharpe per path."""
    n, scope = bound(spark, sf), ["path"]
    nation = S.nation_m(spark, sf)
    folds = FD.cpcv_folds(nation, N_GROUPS, K_TEST)
    days = nation_days(spark, sf)
    test = folds.filter("is_test").select("path", "ts")
    oos = B.return_stats(days.join(test, "ts"), scope).select("path", F.col("sharpe_ratio").alias("oos_sharpe"))
    train = FD.in_sample_dates(folds)
    source = nation.join(train.select("path", "ts"), "ts")
    inside, _ = B.backtest_days(lambda p: rank_signal(p, scope, n), source.select("path", "ts", "asset", "value"), None, CONFIG, None, spreads(spark, sf), scope, n)
    tail = inside.join(train.filter("is_tail").select("path", "ts"), ["path", "ts"])
    ins = B.return_stats(tail, scope).select("path", F.col("sharpe_ratio").alias("is_sharpe"))
    return folds.select("path").distinct().join(oos, "path", "left").join(ins, "path", "left")


@query("cpcv_paths", ctes("nation_m", *cpcv_path_steps()) + f"SELECT CAST(path AS INTEGER) AS path, {rnd_sql('oos_sharpe')} AS oos_sharpe, {rnd_sql('is_sharpe')} AS is_sharpe FROM cp")
def cpcv_paths(spark, sf):
    return edge(cpcv_table(spark, sf))


@query("cpcv_summary", ctes("nation_m", *cpcv_path_steps()) + f"SELECT {rnd_sql('avg(oos_sharpe)')} AS oos_sharpe_mean, {rnd_sql('stddev_samp(oos_sharpe)')} AS oos_sharpe_std, {rnd_sql('median(oos_sharpe)')} AS oos_sharpe_median, count(*) AS n_paths FROM cp")
def cpcv_summary(spark, sf):
    return edge(FD.cpcv_summary(cpcv_table(spark, sf)))


@query("pbo_rank_logit", ctes("nation_m", *cpcv_path_steps(), ("rk", f"SELECT (rank() OVER (ORDER BY is_sharpe) + (count(*) OVER (PARTITION BY is_sharpe) - 1) / 2.0 - 0.5) / count(*) OVER () AS a, (rank() OVER (ORDER BY oos_sharpe) + (count(*) OVER (PARTITION BY oos_sharpe) - 1) / 2.0 - 0.5) / count(*) OVER () AS b FROM cp WHERE is_sharpe IS NOT NULL AND oos_sharpe IS NOT NULL")) +
    f"SELECT CASE WHEN count(*) < 2 THEN 0.5 ELSE {rnd_sql('avg(CASE WHEN ln(a / (1 - a)) - ln(b / (1 - b)) > 0 THEN 1.0 ELSE 0.0 END)')} END AS pbo FROM rk")
def pbo_rank_logit(spark, sf):
    return edge(FD.pbo_rank_logit(cpcv_table(spark, sf)))


# --- report tables ----------------------------------------------------------------------------

DAYS = ["nation_m", *days_steps(), ("al", "SELECT 1 AS run, ts, gross, coalesce(net, 0) AS net FROM dy WHERE gross IS NOT NULL")]


def _aligned(spark, sf):
    return RP.aligned_returns(nation_days(spark, sf)).withColumn("run", F.lit(1))


_MONTH_COLS = ", ".join(f"round(sum(ret) FILTER (month(q) = {m}), 6) + 0.0 AS \"{m}\"" for m in range(1, 13))
_MATRIX = [("mo", "SELECT run, last_day(ts) AS q, product(1 + net) - 1 AS ret FROM al GROUP BY 1, 2")]


@query("monthly_returns_matrix", ctes(*DAYS, *_MATRIX, ("sp", "SELECT run, CAST(date_trunc('month', min(q)) AS DATE) AS a, max(q) AS b FROM mo GROUP BY 1"), ("gd", "SELECT run, last_day(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)) AS q FROM sp"),
    ("mm", "SELECT gd.run, gd.q, coalesce(mo.ret, 0) AS ret FROM gd LEFT JOIN mo USING (run, q)")) + f"SELECT run, CAST(year(q) AS INTEGER) AS year, {_MONTH_COLS} FROM mm GROUP BY 1, 2")
def monthly_returns_matrix(spark, sf):
    return edge(RP.monthly_returns_matrix(_aligned(spark, sf), ["run"]))


@query("monthly_cost_bps", ctes(*DAYS) + f"SELECT run, {sday('last_day(ts)', 'month')}, {rnd_sql('sum((gross - net) * 10000)', 4)} AS cost_bps FROM al GROUP BY run, last_day(ts)")
def monthly_cost_bps(spark, sf):
    return edge(RP.monthly_cost_bps(nation_days(spark, sf).withColumn("run", F.lit(1)), ["run"]), digits=4)


@query("gross_net_curves", ctes(*DAYS) + f"SELECT run, {sday()}, {rnd_sql('product(1 + gross) ' + over('run') + ' - 1')} AS gross_curve, {rnd_sql('product(1 + net) ' + over('run') + ' - 1')} AS net_curve FROM al")
def gross_net_curves(spark, sf):
    return edge(RP.gross_net_curves(nation_days(spark, sf).withColumn("run", F.lit(1)), ["run"]))


_FMT = " UNION ALL ".join(
    f"SELECT run, {i} AS position, '{label}' AS label, CASE WHEN {c} IS NULL THEN 'n/a' ELSE " + (f"printf('%.2f%%', {c} * 100)" if kind == "percent" else f"printf('%d periods', {c})" if kind == "periods" else f"printf('%.2f', {c})") + " END AS value FROM al2"
    for i, (label, c, kind) in enumerate(RP.SUMMARY_ROWS))


@query("summary_table", ctes("nation_m", *days_steps(), ("d1", "SELECT 1 AS run, * FROM dy"), ("b1", "SELECT 1 AS run, * FROM bk"), *stats_steps("d1"), *trade_stats_steps("d1", "run", "b1"), ("al2", "SELECT * FROM stats JOIN tstats USING (run)")) + _FMT)
def summary_table(spark, sf):
    days, traded = days_and_trades(spark, sf)
    stats = _rounded(B.backtest_result(days.withColumn("run", F.lit(1)), traded.withColumn("run", F.lit(1)), ["run"]))
    return RP.summary_table(stats, ["run"])


@query("corr_matrix", ctes("nation_m_x") + f"SELECT x.asset AS a, y.asset AS b, {rnd_sql(S.corr_sql('x.value', 'y.value'))} AS corr FROM nation_m_x x JOIN nation_m_x y ON x.ts = y.ts WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2")
def corr_matrix(spark, sf):
    return edge(RP.corr_matrix(S.nation_m(spark, sf)))


_NATIONS = [f"NATION_{i}" for i in range(25)]


@query("signal_heatmap_table", ctes(*PANEL) + f"SELECT {sday()}, " + ", ".join(f"round(max(value) FILTER (asset = '{a}'), 6) + 0.0 AS \"{a}\"" for a in _NATIONS) + " FROM ns GROUP BY ns.ts")
def signal_heatmap_table(spark, sf):
    return edge(RP.signal_heatmap_table(rank_signal(prices(spark, sf), limit=bound(spark, sf)), _NATIONS))
