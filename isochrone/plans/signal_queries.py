"""Signals, normalisation and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frequency as Q
from ..functions.spark import materialise
from ..operators import combine as W
from ..operators import evaluate as E
from ..operators import panel as P
from ..operators import reports as RP
from ..operators import resample as R
from ..operators import signals as G
from ..operators.backtest import rolling_mean_ic
from ..operators.cross import cross_ic
from ..operators.series import with_windows
from . import panels as S
from .panels import corr_sql, ctes, div_sql, edge, ln_sql, rank_corr_sql, rank_sql, rnd_sql, sday, sts
from .registry import query

HORIZONS = [1, 2, 3, 6]
BASE = 0  # the supplier whose rate is the base rate
SUPPLIERS = "(SELECT count(*) FROM supplier)"


def _suppliers(spark, sf):
    return S.universe(spark, sf, "supplier")


# --- inputs shared by several queries ---------------------------------------------------------

def lagged_monthly(spark, sf):
    """Supplier prices known at each month: last month's."""
    return S.supp_x(spark, sf).select("asset", "ts", F.col("prev").alias("value"))


def _prices(spark, sf):
    return S.supp_x(spark, sf).select("asset", "ts", "value")


def momentum(spark, sf, formation=12):
    n = _suppliers(spark, sf)
    return G.momentum_from_monthly(lagged_monthly(spark, sf), formation, 1, n, bound=n, is_dense=True)


def momentum_pairs(spark, sf, horizons=(1,)):
    fwd = E.forward_return(E.log_returns_panel(_prices(spark, sf)), list(horizons))
    return E.paired(momentum(spark, sf), fwd)


def buckets_sql(src: str, k_long: str, k_short: str, n: str, prefix: str):
    """Steps from ``src(ts, asset, v)`` to ``{prefix}sig(ts, asset, value)``."""
    return [
        (f"{prefix}rk", f"SELECT ts, asset, {rank_sql('ts', 'v')} AS rk, count(*) OVER (PARTITION BY ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY v, asset) AS o FROM {src} WHERE v IS NOT NULL"),
        (f"{prefix}sig", f"SELECT d.ts, d.asset, CASE WHEN r.o > {n} - {k_long} OR r.o <= {k_short} THEN r.rk / r.n * 2 - 1 ELSE 0.0 END AS value FROM {src} d LEFT JOIN {prefix}rk r ON r.ts = d.ts AND r.asset = d.asset"),
    ]


def past_return_sql(src: str, formation: int, name: str):
    lag = "lag(value, {}) OVER (PARTITION BY asset ORDER BY ts)"
    return (name, f"SELECT ts, asset, {div_sql(lag.format(1), lag.format(1 + formation))} - 1 AS v FROM {src}")


DECILE = f"greatest(1, floor({SUPPLIERS} * 0.1))"
LAGGED = [("lm", "SELECT ts, asset, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS value FROM supp_m"), ("lm_x", S.dense_sql("lm"))]


def momentum_sql(formation: int = 12, prefix: str = "m"):
    return [*LAGGED, past_return_sql("lm_x", formation, f"{prefix}ret"), *buckets_sql(f"{prefix}ret", DECILE, DECILE, SUPPLIERS, prefix)]


def forward_sql(horizons, src="supp_m_x", name="fwd"):
    logs = f"SELECT ts, asset, {ln_sql('value')} - {ln_sql('lag(value) OVER (PARTITION BY asset ORDER BY ts)')} AS r FROM {src}"
    rows = " UNION ALL ".join(f"SELECT ts, asset, {h} AS horizon, lead(r, {h + 1}) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM lr" for h in horizons)
    return [("lr", logs), (name, rows)]


PAIRS_SQL = ("pr", "SELECT f.horizon, f.ts, f.asset, s.value AS signal, f.fwd FROM msig s JOIN fwd f ON f.ts = s.ts AND f.asset = s.asset WHERE s.value IS NOT NULL AND f.fwd IS NOT NULL")
MOMENTUM_PAIRS = ["supp_m", "supp_m_x", *momentum_sql(), *forward_sql([1]), PAIRS_SQL]
IC_STEPS = [("rr", f"SELECT horizon, ts, {rank_sql('horizon, ts', 'signal')} AS a, {rank_sql('horizon, ts', 'fwd')} AS b FROM pr"),
    ("ic", f"SELECT horizon, ts, {rank_corr_sql('a', 'b')} AS ic FROM rr GROUP BY 1, 2")]


# --- signals ----------------------------------------------------------------------------------

def _carry(spark, sf):
    n = _suppliers(spark, sf)
    return G.carry_signal(S.rate_m(spark, sf), BASE, n_pairs=n - 1, bound=n)


@query("sma_crossover", ctes("supp_m", ("l", "SELECT ts, asset, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS px FROM supp_m"),
    ("w", "SELECT ts, asset, CASE WHEN count(px) OVER a = 3 THEN avg(px) OVER a END AS fast, CASE WHEN count(px) OVER b = 12 THEN avg(px) OVER b END AS slow FROM l "
          "WINDOW a AS (PARTITION BY asset ORDER BY ts ROWS 2 PRECEDING), b AS (PARTITION BY asset ORDER BY ts ROWS 11 PRECEDING)")) +
    f"SELECT {sday()}, asset, CASE WHEN fast <> slow THEN round(sign(fast - slow) * tanh(abs((fast - slow) / slow) * 10), 6) + 0.0 END AS value FROM w")
def sma_crossover(spark, sf):
    return edge(G.sma_crossover(S.supp_m(spark, sf), 3, 12, True))


CARRY_STEPS = [("cl", "SELECT ts, asset, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS value FROM rate_m"), ("cx", S.dense_sql("cl")),
    ("cd", f"SELECT a.ts, a.asset, a.value - b.value AS v FROM cx a JOIN cx b ON b.ts = a.ts AND b.asset = {BASE} WHERE a.asset <> {BASE}"),
    *buckets_sql("cd", "3", "3", f"({SUPPLIERS} - 1)", "c")]


@query("carry_signal", ctes("rate_m", *CARRY_STEPS) + f"SELECT {sday()}, asset, {rnd_sql('value')} AS value FROM csig")
def carry_signal(spark, sf):
    return edge(_carry(spark, sf))


_MONTHLY = [("l", "SELECT asset, ts, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS v FROM supp_d"),
    ("p", "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS q, max_by(v, ts) FILTER (v IS NOT NULL) AS v FROM l GROUP BY 1, 2"),
    ("s", "SELECT asset, min(q) AS lo, max(q) AS hi FROM p GROUP BY 1"),
    ("g", "SELECT asset, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS q FROM s"),
    ("mc", "SELECT g.asset, CAST(last_day(g.q) AS DATE) AS ts, p.v AS value FROM g LEFT JOIN p USING (asset, q)"), ("mc_x", S.dense_sql("mc"))]


@query("momentum_signal", ctes("supp_d", *_MONTHLY, past_return_sql("mc_x", 12, "mret"), *buckets_sql("mret", DECILE, DECILE, SUPPLIERS, "m")) +
    f"SELECT {sday()}, asset, {rnd_sql('value')} AS value FROM msig")
def momentum_signal(spark, sf):
    n = _suppliers(spark, sf)
    return edge(G.momentum_signal(S.supp_d(spark, sf), 12, 1, n, bound=n))


_WIDE_SQL = ctes("supp_m", *momentum_sql()) + f"SELECT {sday()}, asset, {rnd_sql('value')} AS value FROM msig"


@query("momentum_signal_unbounded", _WIDE_SQL)
def momentum_signal_unbounded(spark, sf):
    """The same ranking by two-level buckets, as used when no bound on the universe is known."""
    return edge(G.momentum_from_monthly(lagged_monthly(spark, sf), 12, 1, _suppliers(spark, sf), is_dense=True))


@query("bucket_select", ctes("supp_m_x", ("o", "SELECT ts, asset, value, row_number() OVER (PARTITION BY ts ORDER BY value, asset) AS o FROM supp_m_x WHERE value IS NOT NULL")) +
    f"SELECT {sday('x.ts', 'ts')}, x.asset, coalesce(o.o > {SUPPLIERS} - 4 OR o.o <= 3, false) AS selected FROM supp_m_x x LEFT JOIN o ON o.ts = x.ts AND o.asset = x.asset")
def bucket_select(spark, sf):
    n = _suppliers(spark, sf)
    return edge(G.bucket_select(_prices(spark, sf), 4, 3, n, bound=n), "ts", "asset", "selected")


@query("normalise_rank", ctes("supp_m_x", ("r", f"SELECT ts, asset, {rank_sql('ts', 'value')} / count(*) OVER (PARTITION BY ts) * 2 - 1 AS v FROM supp_m_x WHERE value IS NOT NULL")) +
    f"SELECT {sday('x.ts', 'ts')}, x.asset, {rnd_sql('r.v')} AS value FROM supp_m_x x LEFT JOIN r ON r.ts = x.ts AND r.asset = x.asset")
def normalise_rank(spark, sf):
    return edge(G.normalise_rank(_prices(spark, sf)), "ts", "asset", "value")


@query("normalise_zscore", ctes("supp_m", ("z", "SELECT ts, asset, (value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w END AS z, count(value) OVER w AS n FROM supp_m WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 11 PRECEDING)")) +
    f"SELECT {sday()}, asset, CASE WHEN n = 12 THEN round(least(greatest(z, -3), 3) / 3, 6) + 0.0 END AS value FROM z")
def normalise_zscore(spark, sf):
    return edge(G.normalise_zscore(S.supp_m(spark, sf), 12), "ts", "asset", "value")


@query("signal_causality", ctes("supp_d", ("nx", "SELECT asset, ts, lead(ts) OVER w AS later, lead(value) OVER w AS v FROM supp_d WINDOW w AS (PARTITION BY asset ORDER BY ts)"),
    ("lk", "SELECT * FROM nx WHERE ts <= DATE '1999-06-30' AND later > DATE '1999-06-30'")) +
    f"SELECT 'peeking' AS signal, {sday()}, asset, {rnd_sql('x')} AS value FROM (SELECT ts, asset, v AS x FROM lk UNION ALL SELECT ts, asset, v * 2 + 1 FROM lk) q")
def signal_causality(spark, sf):
    """Look-ahead audit: no row of the momentum signal may come out, and for the control, which takes the next value
    of its series, the last row of every series before the cut must, as it was and as it became."""
    n, cut, data = _suppliers(spark, sf), "1999-06-30", S.supp_d(spark, sf)
    honest = G.look_ahead_rows(lambda d: G.momentum_signal(d, 6, 1, n, bound=n), data, cut).withColumn("signal", F.lit("momentum"))
    peeking = G.look_ahead_rows(lambda d: with_windows(d, ["asset"], lambda w: {"value": F.lead("value", 1).over(w)}, after=1), data, cut).withColumn("signal", F.lit("peeking"))
    return edge(honest.unionByName(peeking), "signal", "ts", "asset", "value")


# --- scorecard parts --------------------------------------------------------------------------

@query("log_returns_panel", ctes("supp_m_x", *forward_sql([1])) + f"SELECT {sday()}, asset, {rnd_sql('r')} AS value FROM lr")
def log_returns_panel(spark, sf):
    return edge(E.log_returns_panel(_prices(spark, sf)), "ts", "asset", "value")


@query("forward_return", ctes("supp_m_x", *forward_sql([1, 3])) + f"SELECT horizon, {sday()}, asset, {rnd_sql('fwd')} AS fwd FROM fwd")
def forward_return(spark, sf):
    return edge(E.forward_return(E.log_returns_panel(_prices(spark, sf)), [1, 3]))


@query("pair_align", ctes(*MOMENTUM_PAIRS) + f"SELECT {sday()}, asset, {rnd_sql('signal')} AS signal, {rnd_sql('fwd')} AS fwd FROM pr")
def pair_align(spark, sf):
    fwd = E.forward_return(E.log_returns_panel(_prices(spark, sf)), [1])
    return edge(P.pair_align(momentum(spark, sf).withColumnRenamed("value", "signal"), fwd), "ts", "asset", "signal", "fwd")


@query("n_observations", ctes(*MOMENTUM_PAIRS) + "SELECT horizon, count(*) AS n_observations FROM pr GROUP BY 1")
def n_observations(spark, sf):
    return momentum_pairs(spark, sf).groupBy("horizon").agg(F.count(F.lit(1)).alias("n_observations"))


@query("ic_by_date", ctes(*MOMENTUM_PAIRS, *IC_STEPS) + f"SELECT {sday()}, {rnd_sql('ic')} AS ic FROM ic")
def ic_by_date(spark, sf):
    return edge(E.ic_by_date(momentum_pairs(spark, sf), ["horizon"], _suppliers(spark, sf)), "ts", "ic")


_IC_SUMMARY = "avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END) / count(*) AS ic_positive_pct"


@query("ic_summary", ctes(*MOMENTUM_PAIRS, *IC_STEPS, ("a", f"SELECT horizon, {_IC_SUMMARY} FROM ic GROUP BY 1")) +
    f"SELECT horizon, {rnd_sql('ic_mean')} AS ic_mean, {rnd_sql('ic_std')} AS ic_std, {rnd_sql('ic_positive_pct')} AS ic_positive_pct, {rnd_sql(div_sql('ic_mean', 'ic_std'))} AS icir FROM a")
def ic_summary(spark, sf):
    return edge(E.ic_summary(E.ic_by_date(momentum_pairs(spark, sf), ["horizon"], _suppliers(spark, sf)), ["horizon"]))


_HIT = "CASE WHEN sign(signal) = sign(fwd) THEN 1.0 ELSE 0.0 END"


@query("hit_rate", ctes(*MOMENTUM_PAIRS) + f"SELECT horizon, round(avg({_HIT}) FILTER (signal <> 0), 6) + 0.0 AS hit_rate FROM pr GROUP BY 1")
def hit_rate(spark, sf):
    return edge(E.hit_rate(momentum_pairs(spark, sf), ["horizon"]))


@query("hit_rate_by_date", ctes(*MOMENTUM_PAIRS, ("d", f"SELECT horizon, ts, avg({_HIT}) AS h FROM pr GROUP BY 1, 2")) + f"SELECT horizon, {rnd_sql('avg(h)')} AS hit_rate_by_date FROM d GROUP BY 1")
def hit_rate_by_date(spark, sf):
    return edge(E.hit_rate_by_date(momentum_pairs(spark, sf), ["horizon"]))


@query("signal_sharpe", ctes(*MOMENTUM_PAIRS, ("d", "SELECT horizon, ts, avg(signal * fwd) AS p FROM pr GROUP BY 1, 2")) +
    f"SELECT horizon, {rnd_sql(div_sql('avg(p)', 'stddev_samp(p)') + ' * sqrt(12)')} AS signal_sharpe FROM d GROUP BY 1")
def signal_sharpe(spark, sf):
    return edge(E.signal_sharpe(momentum_pairs(spark, sf), ["horizon"], "monthly"))


@query("signal_turnover", ctes("supp_m_x", ("z", "SELECT *, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z, count(value) OVER w AS n FROM supp_m_x WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 11 PRECEDING)"),
    ("s", "SELECT ts, asset, CASE WHEN n = 12 THEN least(greatest(z, -3), 3) / 3 END AS value FROM z"), ("d", "SELECT abs(value - lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS d FROM s")) +
    f"SELECT 1 AS run, {rnd_sql('avg(d)')} AS turnover FROM d")
def signal_turnover(spark, sf):
    signal = G.normalise_zscore(_prices(spark, sf), 12).withColumn("run", F.lit(1))
    return edge(E.signal_turnover(signal, ["run"]))


def decay_sql(keys: str, src: str = "ic"):
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return [
        ("hi", f"SELECT {keys}, ic, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WHERE ic IS NOT NULL"),
        ("hl", f"SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, b.i - a.i AS lag, a.ic AS x, b.ic AS y FROM hi a JOIN hi b ON {on} AND b.i > a.i AND b.i - a.i <= least(252, a.n // 2) WHERE a.n >= 5"),
        ("hc", f"SELECT {keys}, lag, {corr_sql('x', 'y')} AS c FROM hl GROUP BY {keys}, lag HAVING count(*) >= 3"),
        ("hh", f"SELECT {keys}, CAST(min(lag) AS DOUBLE) AS halflife FROM hc WHERE c <= 0.5 GROUP BY {keys}"),
    ]


@query("ic_decay_halflife", ctes(*MOMENTUM_PAIRS, *IC_STEPS, *decay_sql("horizon"), ("k", "SELECT DISTINCT horizon FROM ic")) + "SELECT horizon, halflife AS decay_halflife FROM k LEFT JOIN hh USING (horizon)")
def ic_decay_halflife(spark, sf):
    return edge(E.ic_decay_halflife(E.ic_by_date(momentum_pairs(spark, sf), ["horizon"], _suppliers(spark, sf)), ["horizon"]))


@query("rolling_mean_ic", ctes(*MOMENTUM_PAIRS, *IC_STEPS) +
    f"SELECT horizon, {sday()}, CASE WHEN count(ic) OVER w = 12 THEN round(avg(ic) OVER w, 6) + 0.0 END AS rolling_ic FROM ic WINDOW w AS (PARTITION BY horizon ORDER BY ts ROWS 11 PRECEDING)")
def rolling_mean_ic_query(spark, sf):
    ic = E.ic_by_date(momentum_pairs(spark, sf), ["horizon"], _suppliers(spark, sf))
    return edge(rolling_mean_ic(ic, ["horizon"], 12), "horizon", "ts", "rolling_ic")


# --- scorecards -------------------------------------------------------------------------------

def three_signals(spark, sf):
    carry = _carry(spark, sf)
    named = [("momentum_12", momentum(spark, sf, 12)), ("momentum_6", momentum(spark, sf, 6)), ("carry", carry)]
    out = None
    for name, df in named:
        part = df.select(F.lit(name).alias("signal_name"), "ts", "asset", "value")
        out = part if out is None else out.unionByName(part)
    return out


def scorecard_sql(signal_steps, horizons, frequency="monthly", periods=12, extra=()):
    """Scorecard over ``sg(signal_name, ts, asset, value)`` whose rows are one per month."""
    h = ", ".join(str(x) for x in horizons)
    return ctes("supp_m_x", *signal_steps, *forward_sql(horizons),
        ("rs", "SELECT signal_name, asset, ts, last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY signal_name, asset ORDER BY ts) AS value FROM sg"),
        ("pr", "SELECT s.signal_name, f.horizon, f.ts, f.asset, s.value AS signal, f.fwd FROM rs s JOIN fwd f ON f.ts = s.ts AND f.asset = s.asset WHERE s.value IS NOT NULL AND f.fwd IS NOT NULL"),
        ("rr", f"SELECT signal_name, horizon, ts, {rank_sql('signal_name, horizon, ts', 'signal')} AS a, {rank_sql('signal_name, horizon, ts', 'fwd')} AS b FROM pr"),
        ("ic", f"SELECT signal_name, horizon, ts, {rank_corr_sql('a', 'b')} AS ic FROM rr GROUP BY 1, 2, 3"),
        *decay_sql("signal_name, horizon"),
        ("ii", f"SELECT signal_name, horizon, {_IC_SUMMARY} FROM ic GROUP BY 1, 2"),
        ("dd", "SELECT signal_name, horizon, ts, avg(signal * fwd) AS p FROM pr GROUP BY 1, 2, 3"),
        ("ss", f"SELECT signal_name, horizon, {div_sql('avg(p)', 'stddev_samp(p)')} * sqrt({periods}) AS sharpe FROM dd GROUP BY 1, 2"),
        ("hr", f"SELECT signal_name, horizon, count(*) AS n, avg({_HIT}) FILTER (signal <> 0) AS hit FROM pr GROUP BY 1, 2"),
        ("tt", "SELECT signal_name, avg(d) AS turnover FROM (SELECT signal_name, abs(value - lag(value) OVER (PARTITION BY signal_name, asset ORDER BY ts)) AS d FROM rs) GROUP BY 1"),
        ("card", f"SELECT hr.signal_name, hr.horizon, '{frequency}' AS frequency, {rnd_sql('ic_mean')} AS ic_mean, {rnd_sql('ic_std')} AS ic_std, {rnd_sql(div_sql('ic_mean', 'ic_std'))} AS icir, {rnd_sql('ic_positive_pct')} AS ic_positive_pct, "
            f"{rnd_sql('hit')} AS hit_rate, {rnd_sql('sharpe')} AS signal_sharpe, {rnd_sql('turnover')} AS turnover, halflife AS decay_halflife, n AS n_observations "
            "FROM hr JOIN ss USING (signal_name, horizon) JOIN ii USING (signal_name, horizon) LEFT JOIN hh USING (signal_name, horizon) JOIN tt USING (signal_name)"), *extra)


_THREE = ["rate_m", *CARRY_STEPS, *momentum_sql(12, "m"), *momentum_sql(6, "q"),
    ("sg", "SELECT 'momentum_12' AS signal_name, ts, asset, value FROM msig UNION ALL SELECT 'momentum_6', ts, asset, value FROM qsig UNION ALL SELECT 'carry', ts, asset, value FROM csig")]


def scorecard(spark, sf, horizons=HORIZONS):
    prices = _prices(spark, sf)
    return E.signal_metrics_panel(three_signals(spark, sf), prices, horizons, "monthly", ["signal_name"], _suppliers(spark, sf))


@query("signal_metrics_panel", scorecard_sql(_THREE, HORIZONS) + "SELECT * FROM card")
def signal_metrics_panel(spark, sf):
    """Flagship: three signals at four horizons, scored over the whole supplier universe in one job."""
    return edge(scorecard(spark, sf))


@query("metrics_report", scorecard_sql(_THREE, [1, 3]) + "SELECT *, n_observations < 8000 AS low_n FROM card")
def metrics_report(spark, sf):
    return edge(RP.metrics_report(scorecard(spark, sf, [1, 3]), 8000))


_QUARTER_STEPS = ["supp_m_x", *momentum_sql(), ("lr", f"SELECT ts, asset, {ln_sql('value')} - {ln_sql('lag(value) OVER (PARTITION BY asset ORDER BY ts)')} AS r FROM supp_m_x"),
    ("qr", "SELECT asset, CAST(date_trunc('quarter', ts) AS DATE) AS ts, sum(r) AS r FROM lr GROUP BY 1, 2"),
    ("qs0", "SELECT asset, CAST(date_trunc('quarter', ts) AS DATE) AS ts, min_by(value, ts) FILTER (value <> 0) AS v FROM msig GROUP BY 1, 2"),
    ("qs", "SELECT asset, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts) AS value FROM qs0")]


def _freq_card(sig, ret, frequency, periods, horizons):
    tag = frequency[:3] + "_"
    rows = " UNION ALL ".join(f"SELECT ts, asset, {h} AS horizon, lead(r, {h + 1}) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM {ret}" for h in horizons)
    return [
        (f"{tag}f", rows), (f"{tag}p", f"SELECT f.horizon, f.ts, s.value AS signal, f.fwd FROM {sig} s JOIN {tag}f f ON f.ts = s.ts AND f.asset = s.asset WHERE s.value IS NOT NULL AND f.fwd IS NOT NULL"),
        (f"{tag}r", f"SELECT horizon, ts, {rank_sql('horizon, ts', 'signal')} AS a, {rank_sql('horizon, ts', 'fwd')} AS b FROM {tag}p"),
        (f"{tag}i", f"SELECT horizon, ts, {rank_corr_sql('a', 'b')} AS ic FROM {tag}r GROUP BY 1, 2"),
        (f"{tag}c", f"SELECT '{frequency}' AS frequency, horizon, {rnd_sql('avg(ic)')} AS ic_mean, {rnd_sql(div_sql('avg(ic)', 'stddev_samp(ic)'))} AS icir, (SELECT count(*) FROM {tag}p p WHERE p.horizon = i.horizon) AS n_observations FROM {tag}i i GROUP BY horizon"),
    ]


@query("evaluate_at_horizons", ctes(*_QUARTER_STEPS, ("ms", "SELECT asset, ts, last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts) AS value FROM msig"),
    *_freq_card("ms", "lr", "monthly", 12, [1, 3, 6, 12]), *_freq_card("qs", "qr", "quarterly", 4, [1, 2, 4])) + "SELECT * FROM mon_c UNION ALL SELECT * FROM qua_c")
def evaluate_at_horizons(spark, sf):
    signal, prices, n = momentum(spark, sf), _prices(spark, sf), _suppliers(spark, sf)
    cards = [E.signal_metrics_panel(signal, prices, h, f, bound=n) for f, h in (("monthly", [1, 3, 6, 12]), ("quarterly", [1, 2, 4]))]
    return edge(cards[0].unionByName(cards[1]), "frequency", "horizon", "ic_mean", "icir", "n_observations")


_LAGGED_SIGNAL = ("sg", "SELECT 'base' AS signal_name, ts, asset, value FROM msig UNION ALL SELECT 'lagged', ts, asset, lag(value, 1) OVER (PARTITION BY asset ORDER BY ts) FROM msig")


@query("metric_delta", scorecard_sql([*momentum_sql(), _LAGGED_SIGNAL], [1, 3], extra=[]) .replace("SELECT * FROM card", "") +
    "SELECT b.horizon, round(abs(v.ic_mean - b.ic_mean), 5) + 0.0 AS delta_ic, round(abs(v.icir - b.icir), 5) + 0.0 AS delta_icir, v.n_observations - b.n_observations AS delta_n FROM card b JOIN card v ON v.horizon = b.horizon AND b.signal_name = 'base' AND v.signal_name = 'lagged'")
def metric_delta(spark, sf):
    """Baseline signal against the same signal published one month later."""
    signal, prices, n = momentum(spark, sf), _prices(spark, sf), _suppliers(spark, sf)
    late = with_windows(signal, ["asset"], lambda w: {"value": F.lag("value", 1).over(w)}, before=1)
    both = signal.withColumn("signal_name", F.lit("base")).unionByName(late.withColumn("signal_name", F.lit("lagged")))
    card = edge(E.signal_metrics_panel(both, prices, [1, 3], "monthly", ["signal_name"], n))
    delta = E.metric_delta(card.filter("signal_name = 'base'"), card.filter("signal_name = 'lagged'"), ["horizon"])
    return edge(delta, "horizon", "delta_ic", "delta_icir", "delta_n", digits=5)


_CUSTOM = ctes("supp_m_x", *momentum_sql(), ("lr", "SELECT ts, asset, CASE WHEN lag(value) OVER w <> 0 THEN value / lag(value) OVER w - 1 END AS r FROM supp_m_x WINDOW w AS (PARTITION BY asset ORDER BY ts)"),
    ("ms", "SELECT asset, ts, last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts) AS value FROM msig"), *_freq_card("ms", "lr", "monthly", 12, [1, 3]))


@query("custom_forward_returns", _CUSTOM + "SELECT * FROM mon_c")
def custom_forward_returns(spark, sf):
    """Scorecard with simple instead of log returns through the override hook."""
    def simple(prices, frequency):
        p = F.col("value")
        return with_windows(prices, ["asset"], lambda w: {"value": F.try_divide(p, F.lag(p, 1).over(w)) - 1}, before=1)

    card = E.signal_metrics_panel(momentum(spark, sf), _prices(spark, sf), [1, 3], "monthly", bound=_suppliers(spark, sf), forward_returns=simple)
    return edge(card, "frequency", "horizon", "ic_mean", "icir", "n_observations")


# single series: hourly event prices, each event type its own signal
_SINGLE = ["event_h", ("l", "SELECT ts, asset, value, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS px FROM event_h"),
    ("w", "SELECT ts, asset, CASE WHEN count(px) OVER b = 12 THEN (px - avg(px) OVER b) / nullif(stddev_samp(px) OVER b, 0) END AS z FROM l WINDOW b AS (PARTITION BY asset ORDER BY ts ROWS 11 PRECEDING)"),
    ("sg", "SELECT ts, asset, CASE WHEN z IS NOT NULL THEN least(greatest(z, -3), 3) / 3 END AS value FROM w"),
    ("lr", f"SELECT ts, asset, {ln_sql('value')} - {ln_sql('lag(value) OVER (PARTITION BY asset ORDER BY ts)')} AS r FROM event_h"),
    ("fw", " UNION ALL ".join(f"SELECT ts, asset, {h} AS horizon, lead(r, {h + 1}) OVER (PARTITION BY asset ORDER BY ts) AS fwd FROM lr" for h in (1, 5))),
    ("pr", "SELECT f.asset, f.horizon, f.ts, s.value AS signal, f.fwd FROM sg s JOIN fw f ON f.ts = s.ts AND f.asset = s.asset WHERE s.value IS NOT NULL AND f.fwd IS NOT NULL"),
    ("ix", "SELECT *, row_number() OVER (PARTITION BY asset, horizon ORDER BY ts) AS i FROM pr")]


def _rolling_sql(window):
    return [("wn", f"SELECT a.asset, a.horizon, a.ts AS e, b.signal, b.fwd, a.i FROM ix a JOIN ix b ON a.asset = b.asset AND a.horizon = b.horizon AND b.i BETWEEN a.i - {window - 1} AND a.i"),
        ("wr", f"SELECT asset, horizon, e, i, {rank_sql('asset, horizon, e', 'signal')} AS x, {rank_sql('asset, horizon, e', 'fwd')} AS y FROM wn"),
        ("ro", f"SELECT asset, horizon, e AS ts, CASE WHEN count(*) = {window} THEN {rank_corr_sql('x', 'y')} END AS ic FROM wr GROUP BY 1, 2, 3")]


def single_signal(spark, sf):
    px = with_windows(S.event_h(spark, sf), ["asset"], lambda w: {"value": F.lag("value", 1).over(w)}, before=1)
    return G.normalise_zscore(px, 12)


@query("rolling_spearman", ctes(*_SINGLE, *_rolling_sql(63)) + f"SELECT asset, horizon, {sts()}, {rnd_sql('ic')} AS rolling_ic FROM ro")
def rolling_spearman(spark, sf):
    fwd = E.forward_return(E.log_returns_panel(S.event_h(spark, sf)), [1, 5])
    return edge(E.rolling_spearman(E.paired(single_signal(spark, sf), fwd), ["asset", "horizon"], Q.ROLLING_IC_WINDOW["daily"]))


@query("signal_metrics_single", ctes(*_SINGLE, *_rolling_sql(63),
    ("fr", f"SELECT asset, horizon, {rank_sql('asset, horizon', 'signal')} AS x, {rank_sql('asset, horizon', 'fwd')} AS y FROM pr"),
    ("fi", f"SELECT asset, horizon, {rank_corr_sql('x', 'y')} AS ic_mean FROM fr GROUP BY 1, 2"),
    ("sp", "SELECT asset, horizon, CASE WHEN count(ic) >= 2 THEN stddev_samp(ic) END AS ic_std, CASE WHEN count(ic) >= 2 THEN sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END) / count(*) END AS pos FROM ro GROUP BY 1, 2"),
    ("hr", f"SELECT asset, horizon, count(*) AS n, avg({_HIT}) FILTER (signal <> 0) AS hit, {div_sql('avg(signal * fwd)', 'stddev_samp(signal * fwd)')} * sqrt(252) AS sharpe FROM pr GROUP BY 1, 2"),
    ("tt", "SELECT asset, avg(d) AS turnover FROM (SELECT asset, abs(value - lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS d FROM sg) GROUP BY 1")) +
    f"SELECT hr.asset, hr.horizon, 'daily' AS frequency, {rnd_sql('ic_mean')} AS ic_mean, {rnd_sql('ic_std')} AS ic_std, {rnd_sql(div_sql('ic_mean', 'ic_std'))} AS icir, {rnd_sql('pos')} AS ic_positive_pct, "
    f"{rnd_sql('hit')} AS hit_rate, {rnd_sql('sharpe')} AS signal_sharpe, {rnd_sql('turnover')} AS turnover, 1.0::DOUBLE AS decay_halflife, n AS n_observations "
    "FROM hr JOIN fi USING (asset, horizon) JOIN sp USING (asset, horizon) JOIN tt USING (asset)")
def signal_metrics_single(spark, sf):
    return edge(E.signal_metrics_single(single_signal(spark, sf), S.event_h(spark, sf), [1, 5], "daily"))


@query("cross_ic_unbounded", ctes(*MOMENTUM_PAIRS, *IC_STEPS) + f"SELECT {sday()}, {rnd_sql('ic')} AS ic FROM ic")
def cross_ic_unbounded(spark, sf):
    """Rank correlation per date without any bound on the cross-section."""
    return edge(cross_ic(momentum_pairs(spark, sf), ["horizon", "ts"], "signal", "fwd"), "ts", "ic")


# --- weights of signals -----------------------------------------------------------------------

FORMATIONS = list(range(1, 9))
PAST = dict(window=24, lag=2, shrink=0.5, least=12)


def formation_signals(spark, sf):
    """Eight signals: past returns over one to eight months, all known a month later."""
    n = {"_lag": F.lag("value", 1), **{f"m{f}": F.lag("value", 1 + f) for f in FORMATIONS}}
    rows = with_windows(lagged_monthly(spark, sf), ["asset"], lambda w: {k: c.over(w) for k, c in n.items()}, before=9)
    each = F.explode(F.array(*[F.struct(F.lit(f"m{f}").alias("signal"), (F.try_divide(F.col("_lag"), F.col(f"m{f}")) - 1).alias("value")) for f in FORMATIONS])).alias("_s")
    return rows.select("ts", "asset", each).select("_s.signal", "ts", "asset", "_s.value")


def formation_ic(spark, sf):
    fwd = E.forward_return(E.log_returns_panel(_prices(spark, sf)), [1])
    named = formation_signals(spark, sf).withColumnRenamed("signal", "config")
    return materialise(E.ic_by_date(E.paired(named, fwd), ["config"], _suppliers(spark, sf)).withColumnRenamed("config", "signal"), "formation-ic")


def _weights_sql() -> list[tuple[str, str]]:
    """The trailing moments of the IC, then the eliminations column by column."""
    k = len(FORMATIONS)
    lag = "lag(value, {}) OVER (PARTITION BY asset ORDER BY ts)"
    returns = " UNION ALL ".join(f"SELECT 'm{f}' AS signal, ts, asset, {div_sql(lag.format(1), lag.format(1 + f))} - 1 AS v FROM lm_x" for f in FORMATIONS)
    steps = [*LAGGED, ("fs", returns), *forward_sql([1]), ("fp", "SELECT s.signal AS sg, s.ts, s.asset, s.v AS signal, f.fwd FROM fs s JOIN fwd f ON f.ts = s.ts AND f.asset = s.asset WHERE s.v IS NOT NULL AND f.fwd IS NOT NULL"),
        ("fr", f"SELECT sg, ts, {rank_sql('sg, ts', 'signal')} AS a, {rank_sql('sg, ts', 'fwd')} AS b FROM fp"), ("fi", f"SELECT sg, ts, {rank_corr_sql('a', 'b')} AS ic FROM fr GROUP BY 1, 2")]
    xs = [f"x{i}" for i in range(k)]
    steps.append(("wd", "SELECT ts, " + ", ".join(f"max(ic) FILTER (sg = 'm{f}') AS x{i}" for i, f in enumerate(FORMATIONS)) + " FROM fi GROUP BY ts"))
    steps.append(("wk", "SELECT ts, " + ", ".join(f"CASE WHEN {' + '.join(xs)} IS NOT NULL THEN {x} END AS {x}" for x in xs) + " FROM wd"))
    frame = f"(ORDER BY ts ROWS BETWEEN {PAST['window'] + PAST['lag'] - 1} PRECEDING AND {PAST['lag']} PRECEDING)"
    steps.append(("sm", "SELECT ts, count(x0) OVER w AS n, " + ", ".join([f"sum(x{i}) OVER w AS s{i}" for i in range(k)] + [f"sum(x{i} * x{j}) OVER w AS p{i}_{j}" for i in range(k) for j in range(k)]) + f" FROM wk WINDOW w AS {frame}"))
    cov = lambda i, j: f"(p{i}_{j} - s{i} * s{j} / n) / nullif(n - 1, 0)"
    shrunk = [f"{cov(i, j)}{'' if i == j else ' * ' + repr(1 - PAST['shrink']) + '::DOUBLE'} AS c{i}_{j}" for i in range(k) for j in range(k)]
    means = [f"s{i} / nullif(n, 0) AS c{i}_{k}" for i in range(k)]
    steps.append(("e0", "SELECT ts, n, " + ", ".join([f"s{i} / nullif(n, 0) / nullif(sqrt({cov(i, i)}), 0) AS icir{i}" for i in range(k)] + shrunk + means) + " FROM sm"))
    for p in range(k):
        scaled = lambda j, p=p: f"CASE WHEN c{p}_{p} > 0 THEN c{p}_{j} / c{p}_{p} END"
        cells = [f"{scaled(j)} AS c{i}_{j}" if i == p else f"c{i}_{j} - c{i}_{p} * ({scaled(j)}) AS c{i}_{j}" for i in range(k) for j in range(k + 1)]
        steps.append((f"e{p + 1}", "SELECT ts, n, " + ", ".join([f"icir{i}" for i in range(k)] + cells) + f" FROM e{p}"))
    gross = {"icir": " + ".join(f"abs(icir{i})" for i in range(k)), "penalised": " + ".join(f"abs(c{i}_{k})" for i in range(k))}
    raw = {"icir": "icir{i}", "penalised": f"c{{i}}_{k}"}
    rows = [f"SELECT '{m}' AS method, 'm{f}' AS signal, ts, CASE WHEN n >= {PAST['least']} AND {gross[m]} > 0 THEN {raw[m].format(i=i)} / ({gross[m]}) ELSE {1 / k!r} END AS weight FROM e{k}" for m in gross for i, f in enumerate(FORMATIONS)]
    return [*steps, ("wt", " UNION ALL ".join([*rows, *[f"SELECT 'equal', 'm{f}', ts, {1 / k!r} FROM e{k}" for f in FORMATIONS]]))]


@query("signal_weights", ctes("supp_m", "supp_m_x", *_weights_sql()) + f"SELECT method, signal, {sday()}, {rnd_sql('weight')} AS weight FROM wt")
def signal_weights(spark, sf):
    ic, names, out = formation_ic(spark, sf), [f"m{f}" for f in FORMATIONS], None
    for method in W.METHODS:
        part = W.signal_weights(ic, names, method, **PAST).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return edge(out, "method", "signal", "ts", "weight")


@query("weighted_combination", ctes("supp_m", "supp_m_x", *_weights_sql()) + f"SELECT {sday('s.ts', 'ts')}, s.asset, {rnd_sql('sum(s.v * w.weight)')} AS value FROM fs s JOIN wt w ON w.ts = s.ts AND w.signal = s.signal AND w.method = 'penalised' GROUP BY s.ts, s.asset")
def weighted_combination(spark, sf):
    """Eight momentum signals weighed by what they predicted in the two years before."""
    weights = W.signal_weights(formation_ic(spark, sf), [f"m{f}" for f in FORMATIONS], **PAST)
    return edge(W.weighted_combination(formation_signals(spark, sf), weights), "ts", "asset", "value")
