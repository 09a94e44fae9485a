"""Signals, scorecards, portfolios, folds and overfitting statistics."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by_ts
from isochrone.functions.numeric import normal_cdf
from isochrone.operators import backtest as B
from isochrone.operators import evaluate as E
from isochrone.operators import folds as FD
from isochrone.operators import overfit as O
from isochrone.operators import portfolio as W
from isochrone.operators import reports as RP
from isochrone.operators import signals as G


def _walk(seed, n, start=100.0):
    rng = np.random.default_rng(seed)
    return (start * np.exp(np.cumsum(rng.normal(0, 0.01, n)))).tolist()


def test_carry_bounds_and_causality(series):
    rates = {"USD": [5.0 + 0.1 * i for i in range(6)], "EUR": [3.0 + 0.04 * i for i in range(6)], "GBP": [4.0 + 0.02 * i for i in range(6)]}
    out = G.carry_signal(series(rates), "USD", 1, 1)
    assert {r.asset for r in out.select("asset").distinct().collect()} == {"EUR", "GBP"}
    assert all(-1 <= v <= 1 for v in by_ts(out, "value", "asset"))
    assert out.filter("ts = date '2024-01-01' and value <> 0").count() == 0  # warm-up is zero, not missing
    last = {r.asset: r.value for r in out.filter("ts = date '2024-01-06'").collect()}
    assert last == {"GBP": 1.0, "EUR": 0.0}
    assert G.look_ahead_rows(lambda d: G.carry_signal(d, "USD", 1, 1), series(rates), "2024-01-03").count() == 0


def test_carry_smoothing_warm_up(series):
    rates = {"USD": [1.0] * 8, "EUR": [2.0] * 8, "GBP": [3.0] * 8}
    out = G.carry_signal(series(rates), "USD", 1, 1, smooth=3)
    assert by_ts(out.filter("asset = 'GBP'"), "value") == [0.0] * 3 + [1.0] * 5


def test_momentum_ends(series):
    n = 650
    xs = {"A": np.linspace(100, 250, n), "B": np.linspace(200, 80, n)} | {f"C{i}": np.linspace(100, 105 + i / 10, n) for i in range(8)}
    out = G.momentum_signal(series(xs, business=True))
    end = out.agg(F.max("ts")).collect()[0][0]
    last = {r.asset: r.value for r in out.filter(F.col("ts") == F.lit(end)).collect()}
    assert last["A"] == 1.0 and last["B"] < 0 and sum(v != 0 for v in last.values()) == 2


def test_crossover_is_causal_and_missing_when_flat(series):
    df = series({"a": _walk(1, 60)})
    f = lambda d: G.sma_crossover(d, 5, 20)
    assert G.look_ahead_rows(f, df, "2024-02-10").count() == 0
    assert by_ts(G.sma_crossover(series({"a": [1.0] * 30}), 5, 20), "value") == [None] * 30
    assert G.look_ahead_rows(lambda d: d, df, "2024-02-10").count() == 0
    cheat = lambda d: d.withColumn("value", F.lead("value").over(__import__("pyspark").sql.Window.partitionBy("asset").orderBy("ts")))
    assert G.look_ahead_rows(cheat, df, "2024-02-10").count() == 2


def test_rank_normalise(series):
    out = G.normalise_rank(series({"a": [1.0], "b": [2.0], "c": [2.0], "d": [None]}))
    got = {r.asset: r.value for r in out.collect()}
    assert math.isclose(got["a"], -1 / 3) and math.isclose(got["b"], 2 / 3) and got["b"] == got["c"] and got["d"] is None


def _perfect(spark, days, assets, horizon, seed=0):
    """Prices whose one-period return, horizon + 1 rows ahead, equals the signal."""
    rng = np.random.default_rng(seed)
    sig = rng.normal(size=(days, assets))
    ret = np.roll(sig, horizon + 1, axis=0) * 0.01
    price = 100 * np.exp(np.cumsum(ret, axis=0))
    d0 = date(2024, 1, 1)
    rows = [(d0 + timedelta(days=t), f"A{i:02d}", float(sig[t, i]), float(price[t, i])) for t in range(days) for i in range(assets)]
    df = spark.createDataFrame(rows, "ts date, asset string, s double, p double")
    return df.select("ts", "asset", F.col("s").alias("value")), df.select("ts", "asset", F.col("p").alias("value"))


@pytest.mark.parametrize("bound", [None, 100])
def test_panel_scorecard_perfect_signal(spark, bound):
    signal, prices = _perfect(spark, 120, 30, 1)
    row = E.signal_metrics_panel(signal, prices, [1], bound=bound).collect()[0]
    assert row.ic_mean > 0.9 and row.hit_rate > 0.95 and row.n_observations == (120 - 2) * 30 and row.ic_positive_pct == 1.0


def test_panel_count_and_horizon_check(spark):
    signal, prices = _perfect(spark, 90, 10, 5)
    assert E.signal_metrics_panel(signal, prices, [5], bound=10).collect()[0].n_observations == (90 - 6) * 10
    with pytest.raises(ValueError, match="positive"):
        E.signal_metrics_panel(signal, prices, [0])
    with pytest.raises(ValueError, match="frequency"):
        E.signal_metrics_panel(signal, prices, [1], "hourly")


def test_single_scorecard(series):
    rng = random.Random(2)
    px = series({"a": _walk(3, 200), "b": _walk(4, 200)})
    sg = series({k: [rng.uniform(-1, 1) for _ in range(200)] for k in "ab"})
    rows = E.signal_metrics_single(sg, px, [1]).collect()
    assert {(r.asset, r.n_observations, r.decay_halflife) for r in rows} == {("a", 198, 1.0), ("b", 198, 1.0)}
    assert all(r.icir is not None for r in rows)
    quarterly = E.signal_metrics_single(sg, px, [1], "quarterly").collect()
    assert all(r.icir is None for r in quarterly)


def test_rolling_spearman_brute(series):
    rng = random.Random(8)
    x, y = [rng.choice([1.0, 2.0, 3.0]) for _ in range(30)], [rng.gauss(0, 1) for _ in range(30)]
    pairs = series({"a": x}, column="signal").join(series({"a": y}, column="fwd"), ["asset", "ts"])
    got = by_ts(E.rolling_spearman(pairs, ["asset"], 6), "rolling_ic")
    assert len(got) == 30 and got[:5] == [None] * 5

    def rank(v):
        v = np.array(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for i in range(5, 30):
        a, b = rank(x[i - 5 : i + 1]), rank(y[i - 5 : i + 1])
        want = None if a.std() == 0 else np.corrcoef(a, b)[0, 1]
        assert (got[i] is None and want is None) or math.isclose(got[i], want, abs_tol=1e-12)
    assert by_ts(E.rolling_spearman(pairs, ["asset"], 1), "rolling_ic") == [None] * 30


def test_turnover_gap_breaks_both(series):
    df = series({"a": [1.0, 2.0, 4.0, 5.0], "b": [0.0] * 4}).filter("not (asset = 'a' and ts = date '2024-01-03')").withColumn("k", F.lit(1))
    assert E.signal_turnover(df, ["k"]).collect()[0].turnover == pytest.approx((1.0 + 0 + 0 + 0) / 4)


def test_halflife(spark):
    rows = [(1, date(2024, 1, 1) + timedelta(days=i), float((i // 4) % 2)) for i in range(40)] + [(2, date(2024, 1, 1) + timedelta(days=i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, ts date, ic double")
    got = {r.k: r.decay_halflife for r in E.ic_decay_halflife(df, ["k"]).collect()}
    x = np.array([float((i // 4) % 2) for i in range(40)])
    want = next(lag for lag in range(1, 21) if np.corrcoef(x[:-lag], x[lag:])[0, 1] <= 0.5)
    assert got == {1: float(want), 2: None}


def _book_inputs(series, n=40):
    prices = series({"A": [100 + 0.2 * i + (0.5 if i % 2 else -0.5) for i in range(n)], "B": [200 + 0.1 * i + (0.2 if i % 2 else -0.2) for i in range(n)]})
    return series({"A": [1.0] * n, "B": [-0.5] * n}), prices


@pytest.mark.parametrize("bound", [None, 10])
def test_construct_invariants(spark, series, bound):
    signal, prices = _book_inputs(series)
    classes = spark.createDataFrame([("A", "x"), ("B", "y")], "asset string, cls string")
    for method in ("vol_target", "risk_parity"):
        book = W.construct_portfolio(signal, prices, classes, method, 0.1, 2.0, 0.2, 5, bound=bound)
        per_day = book.groupBy("ts").agg(F.sum(F.abs("weight")).alias("g"), F.abs(F.sum("weight")).alias("n")).collect()
        assert all(r.g <= 2.0 + 1e-9 and r.n <= 0.2 + 1e-9 for r in per_day) and max(r.g for r in per_day) > 0
        w, t = by_ts(book.filter("asset = 'A'"), "weight"), by_ts(book.filter("asset = 'A'"), "trade")
        assert np.allclose(np.diff([0.0, *w]), t)
    with pytest.raises(ValueError, match="sizing_method"):
        W.construct_portfolio(signal, prices, sizing_method="kelly")
    with pytest.raises(ValueError, match="prices missing"):
        W.vol_target_weights(signal, prices.filter("asset = 'A'"), strict=True)
    with pytest.raises(ValueError, match="classes missing"):
        W.risk_parity_weights(signal, prices, classes.filter("asset = 'A'"), strict=True)
    with pytest.raises(ValueError, match="vol_window"):
        W.realised_vol(prices, 1)


def test_risk_parity_equal_class_gross(spark, series):
    n = 30
    prices = series({k: _walk(i, n) for i, k in enumerate(["EQ1", "EQ2", "FX1", "FX2"])})
    signal = series({k: [1.0] * n for k in ["EQ1", "EQ2", "FX1", "FX2"]})
    classes = spark.createDataFrame([("EQ1", "equity"), ("EQ2", "equity"), ("FX1", "fx"), ("FX2", "fx")], "asset string, cls string")
    w = W.risk_parity_weights(signal, prices, classes, vol_window=5).join(classes, "asset")
    last = w.filter(F.col("ts") == F.lit(date(2024, 1, 30))).groupBy("cls").agg(F.sum(F.abs("weight")).alias("g")).collect()
    assert math.isclose(last[0].g, last[1].g) and last[0].g > 0


def test_costs(spark, series):
    gross = series({"x": [0.01, 0.02, 0.03]}).select("ts", F.col("value").alias("gross"))
    traded = series({"A": [0.0, 0.2, 0.0]}).select("ts", "asset", F.col("value").alias("trade"))
    net = by_ts(W.apply_costs(gross, traded), "net")
    assert net[0] == 0.01 and net[2] == 0.03 and math.isclose(net[1], 0.02 - 7 / 1e4)
    adv = spark.createDataFrame([(1.0, 0.0)], "s double, adv double")
    with pytest.raises(Exception, match="adv must be"):
        adv.select(W.trade_cost_bps(F.col("s"), F.col("adv"), F.lit(1.0))).collect()


def test_backtest_and_folds(spark, series):
    prices = series({"A": _walk(1, 50), "B": _walk(2, 50)})
    signal = lambda p: G.sma_crossover(p, 2, 5)
    config = {"vol_window": 5, "net": 0.2}
    days, traded = B.backtest_days(signal, prices, None, config, bound=2)
    test, moved = B.backtest(days, traded, 20, 10)
    assert test.count() == 10 and test.filter("net > gross + 1e-12").count() == 0
    stats = B.backtest_result(test.withColumn("run", F.lit(1)), moved.withColumn("run", F.lit(1)), ["run"]).collect()[0]
    assert stats.max_drawdown <= 0 and stats.turnover_annual >= 0
    with pytest.raises(ValueError, match="calendar rows"):
        B.backtest(days, traded, 45, 10)
    with pytest.raises(ValueError, match="instruments"):
        B.backtest_days(signal, prices, None, {"instruments": ["A"]})
    one, _ = B.backtest_days(signal, prices, None, config, reference_asset="A", bound=2)
    assert one.filter("gross is null").count() == 1  # the last date has no forward return


def test_fold_tables(spark):
    cal = lambda n: spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i),) for i in range(n)], "ts date")
    expanding = FD.walk_forward_folds(cal(45), 12, 6)
    train = {r.fold: r.n for r in expanding.filter("not is_test").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [train[k] for k in sorted(train)] == FD.expanding_train_rows(45, 12, 6) == [12, 18, 24, 30, 36]
    assert {r.n for r in expanding.filter("is_test").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} == {6}
    rolling = FD.walk_forward_folds(cal(50), 14, 7, "rolling")
    got = {r.fold: (r.a, r.b) for r in rolling.groupBy("fold").agg(F.count_if(~F.col("is_test")).alias("a"), F.count_if("is_test").alias("b")).collect()}
    assert got == {k: (14, 7) for k in range(5)} and FD.rolling_train_rows(5, 14) == [14] * 5
    paths = FD.cpcv_folds(cal(42), 4, 2)
    assert paths.select("path").distinct().count() == 6
    assert {r.n for r in FD.cpcv_groups(cal(42), 4).filter("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()} == {10, 11}
    assert FD.combinations_table(spark, 12, 4).select("path").distinct().count() == 495
    assert FD.combinations_table(spark, 12, 4, limit=50).select("path").distinct().count() == 50
    with pytest.raises(ValueError):
        FD.combinations_table(spark, 4, 5)


def test_drawdown_duration(spark, series):
    xs = {"a": [0.1, -0.2, 0.1, 0.3, -0.05], "b": [0.01] * 5, "c": [0.5, -0.5, 0.1, 0.1, 0.1]}
    out = {r.asset: r for r in B.drawdown_duration(series(xs, column="net"), ["asset"]).collect()}
    assert math.isclose(out["a"].max_drawdown, -0.2) and out["a"].max_drawdown_duration == 3
    assert out["b"].max_drawdown_duration == 0 and out["c"].max_drawdown_duration == 4


def test_sharpe_edges(series):
    out = {r.asset: r.sharpe for r in B.avg_sharpe_clean(series({"a": [0.1], "b": [0.1, 0.1], "c": [0.1, float("nan"), 0.3]}, column="ret"), ["asset"]).collect()}
    assert out["a"] is None and out["b"] == float("-inf") and out["c"] > 0


def test_deflated_sharpe(spark):
    df = spark.createDataFrame([(3.0, 252, 0.0, 3.0), (0.2, 252, 0.0, 3.0)], "s double, n long, sk double, ku double")
    one, many = (df.select(O.deflated_sharpe_col(F.col("s"), n, F.col("n"), F.col("sk"), F.col("ku"))).collect() for n in (1, 1000))
    assert one[0][0] >= 0.99 and many[1][0] <= 0.05
    cdf = spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double").select(normal_cdf(F.col("z"))).collect()
    assert np.allclose([r[0] for r in cdf], [0.0249979, 0.5, 0.8413447], atol=1e-6)
    with pytest.raises(ValueError):
        O.expected_max_sharpe(0)


def test_masks_number_combinations_in_order(spark):
    for n, limit in ((2, None), (6, None), (8, 9), (12, 40)):
        masks = [sum(1 << (n - 1 - c) for c in combo) for combo in O.cscv_combinations(n, limit)]
        ranks = O.chosen_combinations(n, limit)
        ranks = list(range(ranks)) if isinstance(ranks, int) else ranks
        df = spark.createDataFrame([(r,) for r in ranks], "r int").select("r", O.mask_of_rank(F.col("r"), n).alias("mask"))
        assert [r.mask for r in df.orderBy("r").collect()] == masks


def test_pbo_alternating_configs(spark, series):
    rng = np.random.default_rng(0)
    a = np.concatenate([np.full(10, 0.01 if k % 2 else -0.01) for k in range(16)]) + rng.normal(0, 1e-4, 160)
    df = series({"x": a, "y": -a}).select("ts", F.col("asset").alias("config"), F.col("value").alias("ret"))
    assert O.pbo_cscv(df, 16, bound=2).collect()[0].pbo > 0.5
    assert O.pbo_cscv(df, 4, None).collect()[0].n_trials == 6
    assert O.pbo_cscv(df, 16).collect()[0].n_trials == 12870 and O.pbo_cscv(df, 16, limit=40).collect()[0].n_trials == 40
    with pytest.raises(ValueError, match="one configuration"):
        O.pbo_cscv(df.filter("config = 'x'"))
    with pytest.raises(ValueError, match="even"):
        O.pbo_cscv(df, 5)
    with pytest.raises(ValueError, match="complete dates"):
        O.pbo_cscv(df.filter("ts < date '2024-01-20'"))


def test_spa_without_common_dates(series):
    strat = series({"a": [0.1, 0.2], "b": [0.3, 0.1]}).select("ts", F.col("asset").alias("config"), F.col("value").alias("ret"))
    bench = series({"m": [0.1, 0.1]}, start=date(2030, 1, 1)).select("ts", F.col("value").alias("ret"))
    row = O.spa_test(bench, strat, 20).collect()[0]
    assert row.statistic is None and row.p_value is None and row.reject_null is False


def test_corr_matrix_of_wanted_pairs(spark, series):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 50))
    df = series({"a": x[0], "b": x[1], "c": [*x[2][:49], None]})
    every = {(r.a, r.b): r.corr for r in RP.corr_matrix(df).collect()}
    assert len(every) == 9 and math.isclose(every["a", "b"], np.corrcoef(x[0], x[1])[0, 1]) and math.isclose(every["c", "a"], np.corrcoef(x[0][:49], x[2][:49])[0, 1])
    some = {(r.a, r.b): r.corr for r in RP.corr_matrix(df, spark.createDataFrame([("a", "c"), ("b", "b")], "a string, b string")).collect()}
    assert set(some) == {("a", "c"), ("b", "b")} and math.isclose(some["a", "c"], every["a", "c"]) and math.isclose(some["b", "b"], 1.0)


def test_spa_winner(series):
    rng = np.random.default_rng(1)
    noise = rng.normal(0, 0.002, (3, 300))
    strat = series({"winner": noise[0] + 0.001, "flat": noise[1], "loser": noise[2] - 0.001}).select("ts", F.col("asset").alias("config"), F.col("value").alias("ret"))
    bench = series({"b": [0.0] * 300}).select("ts", F.col("value").alias("ret"))
    row = O.spa_test(bench, strat, 200).collect()[0]
    assert row.best_config == "winner" and row.reject_null and 0 < row.p_value < 0.05
    with pytest.raises(ValueError):
        O.spa_test(bench, strat, 0)


def test_pbo_rank_logit_short(spark):
    df = spark.createDataFrame([(0, 1.0, None)], "path int, is_sharpe double, oos_sharpe double")
    assert FD.pbo_rank_logit(df).collect()[0].pbo == 0.5
    rows = [(i, float(i), float(-i)) for i in range(4)]
    assert FD.pbo_rank_logit(spark.createDataFrame(rows, df.schema)).collect()[0].pbo == 0.5


def test_pbo_rank_logit_ties(spark):
    """Sharpes that differ by the order of summation only are tied, whichever way the noise goes."""
    shape = "path int, is_sharpe double, oos_sharpe double"
    for noise in (1e-14, -1e-14):
        rows = [(i, 2.0 + i * noise, float(3 - i)) for i in range(3)]
        assert math.isclose(FD.pbo_rank_logit(spark.createDataFrame(rows, shape)).collect()[0].pbo, 1 / 3)


def test_reports(series):
    n = 300
    days = series({"x": [0.0005 + 0.002 * math.sin(i) for i in range(n)]}).select("ts", F.col("value").alias("gross"), (F.col("value") - 5e-5).alias("net")).withColumn("run", F.lit(1))
    matrix = RP.monthly_returns_matrix(days, ["run"]).collect()
    assert [r.year for r in matrix] == [2024] and matrix[0]["10"] is not None and matrix[0]["12"] is None
    bps = sum(r.cost_bps for r in RP.monthly_cost_bps(days, ["run"]).collect())
    assert math.isclose(bps, n * 0.5, rel_tol=1e-9)
    assert B.rolling_sharpe(days, ["run"]).filter("rolling_sharpe is null").count() == 19
    stats = B.return_stats(days, ["run"]).withColumns({"total_cost_bps": F.lit(1.0), "turnover_annual": F.lit(None).cast("double")})
    table = {r.label: r.value for r in RP.summary_table(stats, ["run"]).collect()}
    assert table["Total cost bps"] == "1.00" and table["Turnover"] == "n/a" and table["Hit rate"].endswith("%") and len(table) == 9
