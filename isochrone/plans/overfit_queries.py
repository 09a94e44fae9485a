"""Overfitting corrections. Configurations are brands, returns their monthly price changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overfit as O
from ..operators.evaluate import log_returns_panel
from ..operators.panel import dense_panel
from . import panels as S
from .panels import ctes, div_sql, edge, ln_sql, rnd_sql
from .registry import query

N_CHUNKS, N_BOOT, SEED = 16, 1000, 7


@S._stored
def brand_returns(spark, sf):
    """``(ts, config, ret)``: monthly log price change per brand."""
    return log_returns_panel(dense_panel(S.brand_m(spark, sf))).select("ts", F.col("asset").alias("config"), F.col("value").alias("ret"))


RETURNS = ["brand_m", "brand_m_x", ("br", f"SELECT ts, asset AS config, {ln_sql('value')} - {ln_sql('lag(value) OVER (PARTITION BY asset ORDER BY ts)')} AS ret FROM brand_m_x")]
MOMENTS = [("m0", "SELECT config, avg(ret) AS mu FROM br GROUP BY 1"),
    ("m1", "SELECT b.config, count(ret) AS n, any_value(mu) AS mu, stddev_samp(ret) AS sd, avg(power(ret - mu, 2)) AS c2, avg(power(ret - mu, 3)) AS c3, avg(power(ret - mu, 4)) AS c4 FROM br b JOIN m0 ON m0.config = b.config GROUP BY 1"),
    ("mo", f"SELECT config, n AS n_obs, {div_sql('mu', 'sd')} AS sharpe, c3 / power(c2, 1.5) AS skew, c4 / (c2 * c2) AS kurt FROM m1")]


@query("sample_moments", ctes(*RETURNS, *MOMENTS) + f"SELECT config, n_obs, {rnd_sql('sharpe')} AS sharpe, {rnd_sql('skew')} AS skew, {rnd_sql('kurt')} AS kurt FROM mo")
def sample_moments(spark, sf):
    return edge(O.sample_moments(brand_returns(spark, sf), ["config"]))


_STAR = O.expected_max_sharpe(25)
_DSR = [("dz", f"SELECT *, (sharpe - ({_STAR!r})) / sqrt((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n_obs - 1)) AS z FROM mo"),
    ("dt", "SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM dz"),
    ("du", "SELECT *, 0.3989422804014327 * exp(-z*z/2) * (0.319381530*t - 0.356563782*t*t + 1.781477937*t*t*t - 1.821255978*t*t*t*t + 1.330274429*t*t*t*t*t) AS u FROM dt")]


@query("deflated_sharpe", ctes(*RETURNS, *MOMENTS, *_DSR) + f"SELECT config, n_obs, {rnd_sql('sharpe')} AS sharpe, {rnd_sql('CASE WHEN z >= 0 THEN 1 - u ELSE u END')} AS dsr FROM du")
def deflated_sharpe(spark, sf):
    return edge(O.deflated_sharpe(brand_returns(spark, sf)), "config", "n_obs", "sharpe", "dsr")


@query("best_config", ctes(*RETURNS, *MOMENTS, ("yr", "SELECT year(ts)::INT AS year, config, avg(ret) AS m FROM br WHERE ret IS NOT NULL GROUP BY 1, 2")) +
    f"SELECT year, arg_min(config, (-m, config)) AS best_config, {rnd_sql('max(m)')} AS mean_ret FROM yr GROUP BY 1")
def best_config(spark, sf):
    means = brand_returns(spark, sf).filter("ret is not null").groupBy(F.year("ts").alias("year"), "config").agg(F.avg("ret").alias("mean_ret"))
    return edge(O.best_config(means, ["year"], "mean_ret"))


def _cscv_steps(limit):
    combos = O.cscv_combinations(N_CHUNKS, limit)
    values = ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(combos))
    sharpe = "CASE WHEN {v} > 0 THEN {m} / sqrt({v}) * sqrt(252) ELSE '-inf'::DOUBLE END"
    return [("cm", "SELECT ts FROM br GROUP BY ts HAVING count(ret) = (SELECT count(DISTINCT config) FROM br)"),
        ("ca", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM cm"),
        ("ck", f"SELECT ts, i // (n // {N_CHUNKS}) AS chunk FROM ca WHERE i < n // {N_CHUNKS} * {N_CHUNKS}"),
        ("cb", f"SELECT * FROM (VALUES {values}) t(combo, train)"),
        ("sc0", "SELECT cb.combo, br.config, list_contains(cb.train, ck.chunk) AS tr, br.ret FROM cb CROSS JOIN ck JOIN br ON br.ts = ck.ts"),
        ("sc1", "SELECT combo, config, avg(ret) FILTER (tr) AS mi, var_samp(ret) FILTER (tr) AS vi, avg(ret) FILTER (NOT tr) AS mo, var_samp(ret) FILTER (NOT tr) AS vo FROM sc0 GROUP BY 1, 2"),
        ("sc", f"SELECT combo, config, {sharpe.format(v='vi', m='mi')} AS is_sharpe, {sharpe.format(v='vo', m='mo')} AS oos_sharpe FROM sc1"),
        ("bw", "SELECT combo, arg_min(config, (-is_sharpe, config)) AS config, max(is_sharpe) AS is_sharpe, median(oos_sharpe) AS median_oos FROM sc GROUP BY 1"),
        ("pt", "SELECT bw.combo, bw.config, bw.is_sharpe, sc.oos_sharpe, bw.median_oos FROM bw JOIN sc ON sc.combo = bw.combo AND sc.config = bw.config")]


@query("cscv_paths", ctes(*RETURNS, *_cscv_steps(None)) + f"SELECT combo, config, {rnd_sql('is_sharpe')} AS is_sharpe, {rnd_sql('oos_sharpe')} AS oos_sharpe, {rnd_sql('median_oos')} AS median_oos FROM pt")
def cscv_paths(spark, sf):
    return edge(O.cscv_paths(brand_returns(spark, sf), N_CHUNKS))


@query("pbo_cscv", ctes(*RETURNS, *_cscv_steps(None)) + f"SELECT {rnd_sql('avg(CASE WHEN oos_sharpe < median_oos THEN 1.0 ELSE 0.0 END)')} AS pbo, count(*) AS n_trials FROM pt")
def pbo_cscv(spark, sf):
    return edge(O.pbo_cscv(brand_returns(spark, sf), N_CHUNKS))


_SPA = [("be", "SELECT ts, avg(ret) * 0.5 AS bench FROM br GROUP BY ts HAVING count(ret) = (SELECT count(DISTINCT config) FROM br)"),
    ("dd", "SELECT br.ts, br.config, br.ret - be.bench AS d FROM br JOIN be ON be.ts = br.ts"),
    ("ca", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM dd)"),
    ("dr", f"SELECT pos, n, greatest(1, floor(power(n, 0.25))) AS l, b AS draw, ('0x' || substr(md5('{SEED}|restart|' || b || '|' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS ur, ('0x' || substr(md5('{SEED}|row|' || b || '|' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS uw FROM ca, range({N_BOOT}) t(b)"),
    ("sr", "SELECT *, CASE WHEN pos = 0 OR ur < 1.0 / l THEN floor(uw * n) END AS row_, CASE WHEN pos = 0 OR ur < 1.0 / l THEN pos END AS at_ FROM dr"),
    ("ix", "SELECT draw, pos, CAST((last_value(row_ IGNORE NULLS) OVER w + pos - last_value(at_ IGNORE NULLS) OVER w) % n AS INT) AS idx FROM sr WINDOW w AS (PARTITION BY draw ORDER BY pos ROWS UNBOUNDED PRECEDING)")]


def _spa_inputs(spark, sf):
    returns = brand_returns(spark, sf)
    bench = O.complete_rows(returns).groupBy("ts").agg((F.avg("ret") * 0.5).alias("ret"))
    return bench, returns


@query("stationary_bootstrap", ctes(*RETURNS, *_SPA) + "SELECT draw, pos, idx FROM ix")
def stationary_bootstrap(spark, sf):
    calendar = O.indexed_calendar(O.complete_rows(brand_returns(spark, sf)))
    n = calendar.agg(F.count(F.lit(1))).scalar()
    block = F.greatest(F.lit(1), F.floor(F.pow(n, F.lit(0.25))))
    return O.stationary_bootstrap(calendar, n, N_BOOT, block, SEED).withColumn("pos", F.col("pos").cast("long"))


@query("spa_test", ctes(*RETURNS, *_SPA, ("me", "SELECT config, avg(d) AS m FROM dd GROUP BY 1"), ("ce", "SELECT dd.config, ca.pos, dd.d - me.m AS d0 FROM dd JOIN me ON me.config = dd.config JOIN ca ON ca.ts = dd.ts"),
    ("bs", "SELECT ix.draw, ce.config, avg(ce.d0) AS m FROM ix JOIN ce ON ce.pos = ix.idx GROUP BY 1, 2"), ("mx", "SELECT draw, max(m) AS stat FROM bs GROUP BY 1"),
    ("ob", "SELECT arg_min(config, (-m, config)) AS best_config, max(m) AS statistic FROM me"),
    ("pv", f"SELECT best_config, statistic, (1 + (SELECT count(*) FROM mx WHERE stat >= statistic)) / ({N_BOOT} + 1.0::DOUBLE) AS p FROM ob")) +
    f"SELECT best_config, {rnd_sql('statistic')} AS statistic, {rnd_sql('p')} AS p_value, p < 0.05 AND statistic > 0 AS reject_null FROM pv")
def spa_test(spark, sf):
    bench, returns = _spa_inputs(spark, sf)
    return edge(O.spa_test(bench, returns, N_BOOT, 0.05, SEED))


