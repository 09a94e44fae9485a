"""Calendars, panels, alignment, cleaning, transforms and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import frequency as Q
from ..functions.numeric import logit, normal_cdf
from ..operators import clean as C
from ..operators import panel as P
from ..operators import resample as R
from ..operators import transforms as T
from . import panels as S
from .panels import ctes, div_sql, edge, ln_sql, rnd_sql, sday, sts
from .registry import query

START, END = "1996-01-01", "1998-12-31"


# --- calendars and scalars -------------------------------------------------------------------

@query("business_calendar", ctes(("b", "SELECT o_orderpriority AS asset, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1"),
    ("d", "SELECT asset, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM b"),
    ("k", "SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM d WHERE isodow(ts) < 6"),
    ("n", "SELECT a.asset, a.ts, b.ts AS plus5, c.ts AS minus3 FROM k a LEFT JOIN k b ON a.asset = b.asset AND b.i = a.i + 5 LEFT JOIN k c ON a.asset = c.asset AND c.i = a.i - 3")) +
    f"SELECT asset, {sday()}, {sday('plus5')}, {sday('minus3')}, {sday('ts + (5 - isodow(ts))::INT', 'week_label')}, {sday('last_day(ts)', 'month_label')}, "
    f"{sday("last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH)", 'quarter_label')} FROM n WHERE plus5 IS NOT NULL AND minus3 IS NOT NULL")
def business_calendar(spark, sf):
    o = S.table(spark, sf, "orders")
    b = o.groupBy(F.col("o_orderpriority").alias("asset")).agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"))
    out = P.business_calendar(b).withColumns({
        "plus5": D.add_business_days(F.col("ts"), 5), "minus3": D.add_business_days(F.col("ts"), -3),
        "week_label": D.period_end(F.col("ts"), "weekly"), "month_label": D.period_end(F.col("ts"), "monthly"), "quarter_label": D.period_end(F.col("ts"), "quarterly"),
    })
    known = (F.col("plus5") <= F.col("last")) & (F.col("minus3") >= F.col("first"))
    return edge(out.filter(known), "asset", "ts", "plus5", "minus3", "week_label", "month_label", "quarter_label")


@query("periods_per_year", ctes(("f", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN 'weekly' WHEN '3-MEDIUM' THEN 'monthly' ELSE 'quarterly' END AS frequency FROM orders")) +
    "SELECT frequency, CASE frequency WHEN 'daily' THEN 252 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 ELSE 4 END AS periods, "
    "round(sqrt(CASE frequency WHEN 'daily' THEN 252 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 ELSE 4 END), 6) AS factor, "
    "CASE frequency WHEN 'daily' THEN 0 WHEN 'weekly' THEN 1 WHEN 'monthly' THEN 2 ELSE 3 END AS freq_rank, "
    "CASE frequency WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 45 ELSE 120 END AS lag_days, count(*) AS n FROM f GROUP BY 1")
def periods_per_year(spark, sf):
    f = S.table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "daily").when(F.col("o_orderpriority") == "2-HIGH", "weekly")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "monthly").otherwise("quarterly").alias("frequency"))
    g = f.groupBy("frequency").agg(F.count(F.lit(1)).alias("n"))
    periods = Q.periods_per_year_col(F.col("frequency"))
    return edge(g.select("frequency", periods.alias("periods"), F.sqrt(periods.cast("double")).alias("factor"),
        Q.frequency_rank_col(F.col("frequency")).alias("freq_rank"), Q.publication_lag_col(F.col("frequency")).alias("lag_days"), "n"))


_CDF = ("(CASE WHEN z >= 0 THEN 1 - u ELSE u END)")
@query("normal_cdf", ctes(("m", "SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd, count(*) AS n FROM orders"),
    ("z", "SELECT o_orderkey, (o_totalprice - mu) / sd AS z, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 0.5) / n AS p FROM orders, m"),
    ("u", "SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z"),
    ("v", "SELECT *, 0.3989422804014327 * exp(-z*z/2) * (0.319381530*t - 0.356563782*t*t + 1.781477937*t*t*t - 1.821255978*t*t*t*t + 1.330274429*t*t*t*t*t) AS u FROM u")) +
    f"SELECT o_orderkey, {rnd_sql('z')} AS z, {rnd_sql(_CDF)} AS cdf, {rnd_sql('ln(p / (1 - p))')} AS logit FROM v")
def normal_cdf_query(spark, sf):
    from ..operators.cross import order_within
    o = S.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    m = o.agg(F.struct(F.avg("o_totalprice").alias("mu"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))).scalar()
    placed = order_within(o.withColumn("_all", F.lit(1)), ["_all"], "o_totalprice", "o_orderkey", "i").withColumn("m", m)
    z = (F.col("o_totalprice") - F.col("m.mu")) / F.col("m.sd")
    out = placed.select("o_orderkey", z.alias("z"), normal_cdf(z).alias("cdf"), logit((F.col("i") - 0.5) / F.col("m.n")).alias("logit"))
    return edge(out)


@query("utc_normalise", f"SELECT event_id, {sts('ts', 'timestamp')} FROM events")
def utc_normalise(spark, sf):
    return edge(P.utc_normalise(S.table(spark, sf, "events").select("event_id", "ts")))


# --- panels and as-of -------------------------------------------------------------------------

@query("range_slice", f"SELECT event_id, {sts()}, round(value, 6) + 0.0 AS value FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-12' + INTERVAL 1 DAY")
def range_slice(spark, sf):
    return edge(P.in_range(S.table(spark, sf, "events"), "2024-01-05", "2024-01-12"), "event_id", "ts", "value")


@query("calendar_union", f"SELECT DISTINCT {sday('CAST(d AS DATE)', 'ts')} FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT l_shipdate FROM lineitem) WHERE d >= DATE '{START}' AND d <= DATE '{END}'")
def calendar_union(spark, sf):
    days = S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("ts")).unionByName(S.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("ts")))
    return edge(P.calendar_union(days, START, END))


@query("index_intersection", f"SELECT DISTINCT {sday('CAST(o_orderdate AS DATE)', 'ts')} FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def index_intersection(spark, sf):
    return edge(P.index_intersection(S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("ts")), S.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("ts"))))


@query("pack_panel", ctes("nation_d_x") + f"SELECT {sday()}, asset, value + 0.0 AS value FROM nation_d_x")
def pack_panel(spark, sf):
    return edge(P.dense_panel(S.nation_d(spark, sf)), "ts", "asset", "value", exact=("value",))


_FFILL = "last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)"
@query("price_panel", ctes(("nation_d", S.PANEL_SQL["nation_d"]), ("z", f"SELECT asset, ts, CASE WHEN value > 480000 THEN 0.0 ELSE value END AS value FROM nation_d WHERE ts >= DATE '{START}' AND ts <= DATE '{END}'"), ("x", S.dense_sql("z")),
    ("f", f"SELECT ts, asset, {_FFILL} AS value FROM x")) + f"SELECT {sday()}, asset, nullif(value, 0) + 0.0 AS value FROM f")
def price_panel(spark, sf):
    zeroed = S.nation_d(spark, sf).withColumn("value", F.when(F.col("value") > 480000, 0.0).otherwise(F.col("value")))
    return edge(P.price_panel(zeroed, START, END), "ts", "asset", "value", exact=("value",))


@query("asof_signal", ctes("nation_m", "nation_d", ("c", "SELECT DISTINCT ts FROM nation_d"), ("s", "SELECT ts + 14 AS ts, asset, value FROM nation_m WHERE value > 200000"),
    ("p", "SELECT c.ts, (SELECT max(s.ts) FROM s WHERE s.ts <= c.ts) AS pts FROM c"), ("a", "SELECT DISTINCT asset FROM nation_d")) +
    f"SELECT {sday('p.ts', 'ts')}, a.asset, coalesce(s.value, 0) + 0.0 AS value FROM p CROSS JOIN a LEFT JOIN s ON s.ts = p.pts AND s.asset = a.asset")
def asof_signal(spark, sf):
    daily = S.nation_d(spark, sf)
    signal = S.nation_m(spark, sf).filter("value > 200000").withColumn("ts", F.date_add("ts", 14))
    return edge(P.asof_signal(signal, daily.select("ts").distinct(), daily.select("asset").distinct()), "ts", "asset", "value", exact=("value",))


@query("asof_ffill_down", ctes("nation_m", ("a", "SELECT DISTINCT asset FROM nation_m"),
    ("g", f"SELECT a.asset, CAST(d.d AS DATE) AS ts FROM a, (SELECT unnest(generate_series(DATE '{START}', DATE '1999-03-31', INTERVAL 1 DAY)) AS d) d WHERE isodow(d.d) < 6")) +
    f"SELECT {sday('g.ts', 'ts')}, g.asset, n.value + 0.0 AS value FROM g ASOF LEFT JOIN nation_m n ON g.asset = n.asset AND g.ts >= n.ts")
def asof_ffill_down(spark, sf):
    return edge(P.asof_ffill(S.nation_m(spark, sf), START, "1999-03-31", "daily"), "ts", "asset", "value", exact=("value",))


# every nation less the one with the next number
@query("difference", ctes("nation_d", ("nx", "SELECT 'NATION_' || ((CAST(asset[8:] AS INT) + 24) % 25) AS asset, ts, value FROM nation_d")) +
    f"SELECT coalesce(l.asset, r.asset) AS asset, {sday('coalesce(l.ts, r.ts)', 'ts')}, l.value - r.value + 0.0 AS value FROM nation_d l FULL JOIN nx r ON l.ts = r.ts AND l.asset = r.asset")
def difference(spark, sf):
    d = S.nation_d(spark, sf)
    before = F.concat(F.lit("NATION_"), ((F.substring("asset", 8, 9).cast("int") + 24) % 25).cast("string"))
    return edge(P.difference(d, d.withColumn("asset", before), ["asset", "ts"]), exact=("value",))


@query("publication_lag", ctes("prio_d", ("b", "SELECT asset, ts, value, CASE WHEN isodow(ts) > 5 THEN ts - (isodow(ts) - 5)::INT ELSE ts END AS f FROM prio_d"),
    ("s", "SELECT asset, ts AS o, CAST(f + 42 AS DATE) AS ts, value FROM b")) + f"SELECT asset, {sday()}, max_by(value, o) + 0.0 AS value FROM s GROUP BY asset, ts")
def publication_lag(spark, sf):
    return edge(P.publication_lag(S.prio_d(spark, sf), 30), "asset", "ts", "value", exact=("value",))


@query("restrict_timestamps", ctes("nation_d") + f"SELECT {sday()}, asset, value + 0.0 AS value FROM nation_d WHERE ts IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')")
def restrict_timestamps(spark, sf):
    dates = S.table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'F'").select(F.to_date("l_shipdate").alias("ts"))
    return edge(P.restrict_timestamps(S.nation_d(spark, sf), dates), "ts", "asset", "value", exact=("value",))


@query("no_lookahead_slice", ctes("nation_d", ("k", f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS i FROM nation_d WHERE ts <= DATE '{END}'")) +
    f"SELECT {sday()}, asset, value + 0.0 AS value FROM k WHERE i <= 60")
def no_lookahead_slice(spark, sf):
    return edge(P.no_lookahead(S.nation_d(spark, sf), END, "rolling", 60), "ts", "asset", "value", exact=("value",))


@query("test_dates_check", "SELECT strftime(d, '%Y-%m-%d') AS ts, d IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P') AS in_calendar FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F')")
def test_dates_check(spark, sf):
    o = S.table(spark, sf, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("ts"))
    calendar = P.calendar_union(o.filter("o_orderstatus = 'P'"))
    return edge(P.check_test_dates(o.filter("o_orderstatus = 'F'").select("ts"), calendar))


@query("train_test_complement", ctes(("c", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders"), ("t", "SELECT ts FROM c ORDER BY ts DESC LIMIT 252")) + f"SELECT {sday()} FROM c WHERE ts NOT IN (SELECT ts FROM t)")
def train_test_complement(spark, sf):
    c = P.calendar_union(S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("ts")))
    return edge(P.train_test_complement(c, P.tail_window(c, 252)))


@query("tail_window", f"SELECT {sday('d', 'ts')} FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d DESC LIMIT 252)")
def tail_window(spark, sf):
    return edge(P.tail_window(S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("ts")), 252))


@query("ordered_read", ctes("prio_d") + f"SELECT {sday()}, asset, value + 0.0 AS value FROM prio_d ORDER BY ts, asset")
def ordered_read(spark, sf):
    return edge(S.prio_d(spark, sf).orderBy("ts", "asset"), "ts", "asset", "value", exact=("value",))


@query("benchmark_align", ctes("brand_m", "nation_m", ("n", "SELECT count(DISTINCT asset) AS k FROM brand_m"), ("m", "SELECT ts, avg(value) AS bench FROM nation_m GROUP BY ts"),
    ("f", "SELECT ts FROM brand_m GROUP BY ts HAVING count(value) = (SELECT k FROM n)")) +
    f"SELECT {sday('b.ts', 'ts')}, b.asset AS config, b.value AS ret, {rnd_sql('m.bench', 4)} AS bench FROM brand_m b JOIN f ON f.ts = b.ts JOIN m ON m.ts = b.ts")
def benchmark_align(spark, sf):
    bench = S.nation_m(spark, sf).groupBy("ts").agg(F.avg("value").alias("ret"))
    strategies = S.brand_m(spark, sf).select("ts", F.col("asset").alias("config"), F.col("value").alias("ret"))
    return edge(P.benchmark_align(bench, strategies), "ts", "config", "ret", "bench", digits=4, exact=("ret",))


@query("signal_combine", ctes("nation_m", "nation_d", ("s", "SELECT ts, asset, value FROM nation_m UNION ALL SELECT ts, asset, value FROM nation_d")) +
    f"SELECT {sday()}, asset, sum(value) / 2 AS value FROM s GROUP BY ts, asset")
def signal_combine(spark, sf):
    both = S.nation_m(spark, sf).withColumn("signal", F.lit("a")).unionByName(S.nation_d(spark, sf).withColumn("signal", F.lit("b")))
    return edge(P.signal_combine(both, 2), "ts", "asset", "value", exact=("value",))


@query("instrument_union", "SELECT s_nationkey AS asset, min(s_suppkey % 7) AS signal_order, arg_min(s_suppkey, (s_suppkey % 7, s_suppkey)) AS first_mention FROM supplier GROUP BY 1")
def instrument_union(spark, sf):
    declared = S.table(spark, sf, "supplier").select((F.col("s_suppkey") % 7).alias("signal_order"), F.col("s_suppkey").alias("position"), F.col("s_nationkey").alias("asset"))
    return P.instrument_union(declared).select("asset", "signal_order", F.col("position").alias("first_mention"))


@query("instrument_prices", ctes("nation_d") + f"SELECT {sday()}, asset, value + 0.0 AS value FROM nation_d WHERE asset IN (SELECT n_name FROM nation WHERE n_regionkey = 2)")
def instrument_prices(spark, sf):
    wanted = S.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("asset"))
    return edge(P.instrument_prices(S.nation_d(spark, sf), wanted), "ts", "asset", "value", exact=("value",))


@query("quote_orientation", ctes("nation_m") + f"SELECT {sday()}, asset || '/BASE' AS asset, CASE WHEN n_nationkey % 2 = 1 THEN 1 / value ELSE value END AS value FROM nation_m JOIN nation ON n_name = asset")
def quote_orientation(spark, sf):
    pairs = S.table(spark, sf, "nation").select(F.concat("n_name", F.lit("/BASE")).alias("pair"), F.col("n_name").alias("spot"), (F.col("n_nationkey") % 2 == 1).alias("invert"))
    return edge(P.quote_orientation(S.nation_m(spark, sf), pairs), "ts", "asset", "value", exact=("value",))


@query("fx_pairs", "SELECT n_name || '/NATION_0' AS pair, n_name AS quote, 'NATION_0' AS base FROM nation WHERE n_name <> 'NATION_0'")
def fx_pairs(spark, sf):
    return P.fx_pairs(S.table(spark, sf, "nation").select(F.col("n_name").alias("ccy")), "NATION_0", strict=True)


# --- cleaning ---------------------------------------------------------------------------------

# priorities on the Mon-Fri calendar of each series: one close per business day, missing where no order fell
_GAPPY = [("g", "SELECT asset, min(ts) AS lo, max(ts) AS hi FROM prio_d GROUP BY 1"),
    ("gappy", "SELECT k.asset, k.ts, p.value AS close FROM (SELECT asset, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM g) k LEFT JOIN prio_d p ON p.asset = k.asset AND p.ts = k.ts WHERE isodow(k.ts) < 6")]


def _gappy(spark, sf):
    p = S.prio_d(spark, sf)
    bounds = p.groupBy("asset").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return P.business_calendar(bounds).join(p, ["asset", "ts"], "left").select("asset", "ts", F.col("value").alias("close"))


def _fill_sql(limit):
    return f"last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)"


# Six-row limit in the queries, so that at the check scale some series pass and some do not.
_LIMIT = 6
_BOUNDED = [*_GAPPY, ("fl", f"SELECT *, {_fill_sql(_LIMIT)} AS filled FROM gappy"), ("bad", "SELECT asset FROM fl WHERE filled IS NULL GROUP BY 1"),
    ("ok", "SELECT asset, ts, filled AS close, CASE WHEN close IS NULL THEN 'ffill' END AS fill_type FROM fl WHERE asset NOT IN (SELECT asset FROM bad)")]


@query("bounded_ffill", ctes("prio_d", *_BOUNDED) + f"SELECT asset, {sday()}, close + 0.0 AS close, fill_type FROM ok")
def bounded_ffill(spark, sf):
    return edge(C.bounded_ffill(_gappy(spark, sf), _LIMIT), "asset", "ts", "close", "fill_type", exact=("close",))


@query("gap_violations", ctes("prio_d", *_GAPPY, ("r", "SELECT *, sum(CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts) AS run FROM gappy")) +
    f"SELECT asset, {sday('min(ts)', 'run_start')}, {sday('max(ts)', 'run_end')}, count(*) AS run_length FROM r WHERE close IS NULL GROUP BY asset, run HAVING count(*) > 3")
def gap_violations(spark, sf):
    return edge(C.missing_runs(_gappy(spark, sf)).filter("run_length > 3"))


@query("source_ffill", ctes("prio_d", *_BOUNDED) + f"SELECT asset, {sday()}, close + 0.0 AS close FROM ok")
def source_ffill(spark, sf):
    return edge(C.source_ffill(_gappy(spark, sf), _LIMIT), "asset", "ts", "close", exact=("close",))


def _z_sql(x, w, part="asset"):
    frame = f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    z = div_sql(f"{x} - avg({x}) {frame}", f"stddev_samp({x}) {frame}")
    return f"(CASE WHEN count({x}) {frame} = {w} THEN {z} END)"


# daily supplier prices are wide enough for a lower threshold to flag some rows
@query("flag_outliers", ctes("supp_d", ("z", f"SELECT asset, ts, value, {_z_sql('value', 60)} AS z FROM supp_d")) +
    f"SELECT asset, {sday()}, value + 0.0 AS close, coalesce(abs(z) > 2.5, false) AS is_outlier FROM z")
def flag_outliers(spark, sf):
    return edge(C.flag_outliers(S.supp_d(spark, sf).withColumnRenamed("value", "close"), 60, 2.5), "asset", "ts", "close", "is_outlier", exact=("close",))


@query("clean_series", ctes("prio_d", *_BOUNDED, ("z", f"SELECT *, {_z_sql('close', 252)} AS z FROM ok")) +
    f"SELECT asset, {sday()}, close + 0.0 AS close, fill_type, coalesce(abs(z) > 5, false) AS is_outlier, 1 AS clean_version FROM z")
def clean_series(spark, sf):
    return edge(C.clean_series(_gappy(spark, sf), _LIMIT), "asset", "ts", "close", "fill_type", "is_outlier", "clean_version", exact=("close",))


# --- transformations --------------------------------------------------------------------------

@query("rolling_zscore", ctes("event_h") + f"SELECT asset, {sts()}, {rnd_sql(_z_sql('value', 24))} AS value FROM event_h")
def rolling_zscore(spark, sf):
    return edge(T.rolling_zscore(S.event_h(spark, sf), 24), "asset", "ts", "value")


@query("log_return", ctes("supp_d", ("r", "SELECT asset, ts, value, lag(value, 5) OVER (PARTITION BY asset ORDER BY ts) AS p FROM supp_d")) +
    f"SELECT asset, {sday()}, {rnd_sql(ln_sql(div_sql('value', 'p')))} AS value FROM r")
def log_return(spark, sf):
    return edge(T.log_return(S.supp_d(spark, sf), 5), "asset", "ts", "value")


@query("yoy_pct_change", ctes("nation_m_x", ("f", f"SELECT asset, ts, {_FFILL} AS value FROM nation_m_x")) +
    f"SELECT asset, {sday()}, {rnd_sql(div_sql('value', 'lag(value, 12) OVER (PARTITION BY asset ORDER BY ts)') + ' - 1')} AS value FROM f")
def yoy_pct_change(spark, sf):
    return edge(T.yoy_pct_change(P.dense_panel(S.nation_m(spark, sf)), "monthly"), "asset", "ts", "value")


_RET = ("r", f"SELECT asset, ts, {ln_sql('value')} - {ln_sql('lag(value) OVER (PARTITION BY asset ORDER BY ts)')} AS value FROM event_h")


def _std_sql(x, w, scale="1.0", part="asset"):
    frame = f"OVER (PARTITION BY {part} ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {frame} = {w} THEN stddev_samp({x}) {frame} * {scale} END)"


@query("rolling_vol", ctes("event_h", _RET) + f"SELECT asset, {sts()}, {rnd_sql(_std_sql('value', 63, 'sqrt(252)'))} AS value FROM r")
def rolling_vol(spark, sf):
    return edge(T.rolling_vol(T.log_return(S.event_h(spark, sf)), 63, "daily", True), "asset", "ts", "value")


@query("run_transformation", ctes("event_h", _RET, ("v", f"SELECT asset, ts, {_std_sql('value', 24, 'sqrt(252)')} AS value FROM r")) +
    f"SELECT asset, {sts()}, {rnd_sql(_z_sql('value', 12))} AS value FROM v")
def run_transformation(spark, sf):
    specs = {
        "CLOSE": {"frequency": "daily"},
        "LOG_RET": {"transformation": "log_return", "source_variable": "CLOSE", "frequency": "daily"},
        "VOL": {"transformation": "rolling_vol", "source_variable": "LOG_RET", "window": 24, "annualised": True, "frequency": "daily"},
    }
    top = {"transformation": "rolling_zscore", "source_variable": "VOL", "window": 12, "frequency": "daily"}
    return edge(T.run_transformation(top, lambda v: S.event_h(spark, sf), specs), "asset", "ts", "value")


# --- resampling -------------------------------------------------------------------------------

@query("resample_last", ctes("nation_d", ("p", "SELECT asset, CAST(ts + (5 - isodow(ts) + CASE WHEN isodow(ts) > 5 THEN 7 ELSE 0 END)::INT AS DATE) AS w, max_by(value, ts) AS value FROM nation_d GROUP BY 1, 2"),
    ("s", "SELECT asset, min(w) AS lo FROM p GROUP BY 1"),
    ("g", f"SELECT asset, CAST(unnest(generate_series(lo, DATE '{END}', INTERVAL 7 DAY)) AS DATE) AS w FROM s")) +
    f"SELECT g.asset, {sday('g.w', 'ts')}, p.value + 0.0 AS value FROM g LEFT JOIN p USING (asset, w)")
def resample_last(spark, sf):
    return edge(R.resample_last(S.nation_d(spark, sf), "weekly", end=END), "asset", "ts", "value", exact=("value",))


_PERIODS = [("s", "SELECT asset, min(q) AS lo, max(q) AS hi FROM p GROUP BY 1"),
    ("g", "SELECT asset, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS q FROM s")]


@query("resample_sum_returns", ctes("nation_d", ("r", f"SELECT asset, ts, {ln_sql('value')} - {ln_sql('lag(value) OVER (PARTITION BY asset ORDER BY ts)')} AS v FROM nation_d"),
    ("p", "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS q, sum(v) AS v FROM r GROUP BY 1, 2"), *_PERIODS) +
    f"SELECT g.asset, {sday('g.q', 'ts')}, {rnd_sql('p.v')} AS value FROM g LEFT JOIN p USING (asset, q)")
def resample_sum_returns(spark, sf):
    from ..operators.evaluate import log_returns_panel
    return edge(R.resample_sum_returns(log_returns_panel(S.nation_d(spark, sf)), "monthly"), "asset", "ts", "value")


@query("resample_first_nonzero", ctes("nation_d", ("z", "SELECT asset, ts, CASE WHEN value < 400000 THEN 0.0 ELSE value END AS v FROM nation_d"),
    ("p", "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS q, min_by(v, ts) FILTER (v <> 0) AS v FROM z GROUP BY 1, 2"), *_PERIODS,
    ("d", "SELECT g.asset, g.q, p.v FROM g LEFT JOIN p USING (asset, q)")) +
    f"SELECT asset, {sday('q', 'ts')}, last_value(v IGNORE NULLS) OVER (PARTITION BY asset ORDER BY q) + 0.0 AS value FROM d")
def resample_first_nonzero(spark, sf):
    sparse = S.nation_d(spark, sf).withColumn("value", F.when(F.col("value") < 400000, 0.0).otherwise(F.col("value")))
    return edge(R.resample_first_nonzero(sparse, "monthly"), "asset", "ts", "value", exact=("value",))


@query("monthly_close_lagged", ctes("supp_d", ("l", "SELECT asset, ts, lag(value) OVER (PARTITION BY asset ORDER BY ts) AS v FROM supp_d"),
    ("p", "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS q, max_by(v, ts) FILTER (v IS NOT NULL) AS v FROM l GROUP BY 1, 2"), *_PERIODS) +
    f"SELECT g.asset, {sday('last_day(g.q)', 'ts')}, p.v + 0.0 AS value FROM g LEFT JOIN p USING (asset, q)")
def monthly_close_lagged(spark, sf):
    return edge(R.monthly_close_lagged(S.supp_d(spark, sf)), "asset", "ts", "value", exact=("value",))


@query("get_variable", ctes("nation_d", ("i", f"SELECT * FROM nation_d WHERE ts >= DATE '{START}' AND ts < DATE '{END}' + INTERVAL 1 DAY"),
    ("p", "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS q, max_by(value, ts) AS v FROM i GROUP BY 1, 2"),
    ("s", "SELECT asset, min(q) AS lo FROM p GROUP BY 1"), ("g", f"SELECT asset, CAST(unnest(generate_series(lo, DATE '{END}', INTERVAL 1 MONTH)) AS DATE) AS q FROM s"),
    ("up", f"SELECT g.asset, last_day(g.q) AS ts, p.v AS value, 'monthly' AS target FROM g LEFT JOIN p USING (asset, q) WHERE last_day(g.q) <= DATE '{END}'"),
    ("nation_m", S.PANEL_SQL["nation_m"]), ("a", "SELECT DISTINCT asset FROM nation_m"),
    ("dg", f"SELECT a.asset, CAST(d.d AS DATE) AS ts FROM a, (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS d) d WHERE isodow(d.d) < 6"),
    ("dn", f"SELECT dg.asset, dg.ts, n.value, 'daily' AS target FROM dg ASOF LEFT JOIN (SELECT * FROM nation_m WHERE ts >= DATE '1995-12-01') n ON dg.asset = n.asset AND dg.ts >= n.ts")) +
    f"SELECT asset, {sday()}, value + 0.0 AS value, target FROM (SELECT * FROM up UNION ALL SELECT * FROM dn)")
def get_variable(spark, sf):
    coarse = R.get_variable(S.nation_d(spark, sf), "daily", "monthly", START, END).withColumn("target", F.lit("monthly"))
    fine = R.get_variable(S.nation_m(spark, sf), "monthly", "daily", START, END).withColumn("target", F.lit("daily"))
    return edge(coarse.unionByName(fine), "asset", "ts", "value", "target", exact=("value",))
