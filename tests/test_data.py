"""Cleaning, transforms, resampling, panels and as-of reads on small known inputs."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import by_ts
from isochrone.functions import dates as D
from isochrone.functions import frequency as Q
from isochrone.operators import clean as C
from isochrone.operators import panel as P
from isochrone.operators import resample as R
from isochrone.operators import transforms as T
from isochrone.sources import landing as L


def test_outliers(series):
    xs = [100 + 10 * i / 299 for i in range(300)]
    xs[260], xs[261] = xs[260] + 10000, xs[261] - 10000
    flags = by_ts(C.flag_outliers(series({"a": xs}, column="close", business=True)), "is_outlier")
    assert flags[260] and flags[261] and not flags[259] and not any(flags[:251])


def test_short_gap_is_filled_and_marked(series):
    xs = [100 + i for i in range(50)]
    xs[10] = xs[11] = None
    rows = C.clean_series(series({"a": xs}, column="close")).orderBy("ts").collect()
    assert rows[10].close == rows[11].close == 109 and rows[10].fill_type == rows[11].fill_type == "ffill"
    assert rows[9].fill_type is None and {r.clean_version for r in rows} == {1}


def test_long_gap_is_refused(series):
    xs = [float(i) for i in range(50)]
    xs[10:14] = [None] * 4
    df = series({"a": xs, "b": range(50)}, column="close")
    assert {r.asset for r in C.bounded_ffill(df).select("asset").distinct().collect()} == {"b"}
    with pytest.raises(ValueError, match="gap"):
        C.bounded_ffill(df, strict=True)
    run = C.missing_runs(df).collect()
    assert [(r.asset, r.run_length) for r in run] == [("a", 4)]
    assert [r.asset for r in C.gap_violations(df).collect()] == ["a"]


def test_leading_missing_is_refused(series):
    with pytest.raises(ValueError):
        C.source_ffill(series({"a": [None, 1.0, 2.0]}, column="close"), strict=True)
    with pytest.raises(ValueError):
        C.source_ffill(series({"a": [1.0, None, None, None, None, 2.0]}, column="close"), strict=True)


def test_rolling_zscore_warm_up_and_constant(series):
    z = by_ts(T.rolling_zscore(series({"a": range(1, 31)}), 10), "value")
    assert z[:9] == [None] * 9 and all(v is not None for v in z[9:])
    assert by_ts(T.rolling_zscore(series({"a": [5.0] * 12}), 10), "value") == [None] * 12


def test_difference_is_outer(spark):
    d = [date(2024, 1, k) for k in range(1, 5)]
    lhs = spark.createDataFrame([(d[0], 1.0), (d[1], 2.0), (d[3], 3.0)], "ts date, value double")
    rhs = spark.createDataFrame([(d[0], 10.0), (d[2], 20.0)], "ts date, value double")
    assert by_ts(P.difference(lhs, rhs), "value") == [-9.0, None, None, None]


@pytest.mark.parametrize("frequency,lag,n", [("monthly", 12, 24), ("quarterly", 4, 12), ("weekly", 52, 60)])
def test_yoy(series, frequency, lag, n):
    got = by_ts(T.yoy_pct_change(series({"a": range(100, 100 + n)}), frequency), "value")
    assert got[:lag] == [None] * lag and math.isclose(got[lag], lag / 100)


def test_log_return_and_chain(series):
    prices = [100.0, 102.0, 101.0, 105.0]
    got = by_ts(T.log_return(series({"a": prices})), "value")
    assert got[0] is None and all(math.isclose(g, math.log(b / a)) for g, a, b in zip(got[1:], prices, prices[1:]))
    df = series({"a": [100 * 1.01 ** (i + (i % 3)) for i in range(80)]})
    specs = {"R": {"transformation": "log_return", "source_variable": "C", "frequency": "daily"}}
    spec = {"transformation": "rolling_vol", "source_variable": "R", "window": 63, "annualised": True, "frequency": "daily"}
    chained = by_ts(T.run_transformation(spec, lambda name: df, specs), "value")
    assert chained[62] is None and chained[63] is not None


def test_transformation_errors(series):
    df = series({"a": [1.0]})
    with pytest.raises(ValueError, match="unknown transformation"):
        T.run_transformation({"transformation": "nope", "frequency": "daily"}, lambda n: df)
    with pytest.raises(ValueError, match="frequency"):
        T.run_transformation({"transformation": "log_return", "source_variable": "X", "frequency": "daily"}, lambda n: df, {"X": {"frequency": "monthly"}})
    with pytest.raises(ValueError, match="two sources"):
        T.run_transformation({"transformation": "difference", "sources": ["X"], "frequency": "daily"}, lambda n: df)
    with pytest.raises(ValueError, match="Unknown frequency"):
        Q.check_frequency("hourly")


def test_weekly_first_nonzero_and_carry(series):
    xs = [0.0] * 20
    xs[2], xs[4] = 0.7, 0.3
    assert by_ts(R.resample_first_nonzero(series({"a": xs}, business=True), "weekly"), "value") == [0.7] * 4
    xs = [0.5] + [0.0] * 14
    assert by_ts(R.resample_first_nonzero(series({"a": xs}, business=True), "weekly"), "value") == [0.5] * 3


def test_weekly_sum(series):
    got = R.resample_sum_returns(series({"a": [0.01, 0.02, -0.01, 0.03, 0.0]}), "weekly").collect()
    assert len(got) == 1 and math.isclose(got[0].value, 0.05) and got[0].ts == date(2024, 1, 5)


def test_sum_keeps_empty_periods_missing(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 10), 0.1), ("a", date(2024, 4, 2), 0.2)], "asset string, ts date, value double")
    out = R.resample_sum_returns(df, "monthly").orderBy("ts").collect()
    assert [(r.ts.month, r.value) for r in out] == [(1, 0.1), (2, None), (3, None), (4, 0.2)]


def test_monthly_to_daily(spark):
    ends = [date(2019, 12, 31)] + [date(2020, m + 1, 1) - timedelta(days=1) for m in range(1, 12)]
    prints = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(ends)], "asset string, ts date, value double")
    out = P.asof_ffill(prints, "2020-01-01", "2020-12-31").orderBy("ts").collect()
    assert all(r.ts.weekday() < 5 and r.value is not None for r in out) and out[-1].value == 11.0 and len(out) == 262
    with pytest.raises(ValueError, match="does not cover"):
        P.asof_ffill(prints, "2019-12-01", "2020-12-31", strict=True)


def test_daily_to_monthly_drops_open_period(series):
    df = series({"a": range(366)}, start=date(2020, 1, 1))
    out = R.resample_last(df, "monthly", "2020-01-01", "2020-12-15").orderBy("ts").collect()
    assert len(out) == 11 and out[0].value == 30.0 and out[0].ts == date(2020, 1, 31)
    with pytest.raises(ValueError, match="does not cover"):
        R.resample_last(df, "monthly", "2019-06-01", "2020-12-31", strict=True)


def test_dense_panel_keeps_missing(series):
    df = series({"a": [1, 2, 3]}).unionByName(series({"b": [4]}, start=date(2024, 1, 3)))
    out = {(r.asset, r.ts.day): r.value for r in P.dense_panel(df).collect()}
    assert out == {("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", 1): None, ("b", 2): None, ("b", 3): 4}
    hourly = series({"a": [1, 2], "b": [3]}, hourly=True)
    assert P.dense_panel(hourly).count() == 4


def test_price_panel_zero_after_fill(series):
    got = by_ts(P.price_panel(series({"a": [1.0, 0.0, None, 2.0]})), "value")
    assert got == [1.0, None, None, 2.0]


def test_asof_signal_uses_last_cross_section(spark, series):
    d = [date(2024, 1, k) for k in range(1, 7)]
    signal = spark.createDataFrame([(d[1], "a", 1.0), (d[1], "b", -1.0), (d[3], "a", 0.5)], "ts date, asset string, value double")
    cal = spark.createDataFrame([(x,) for x in d], "ts date")
    inst = spark.createDataFrame([("a",), ("b",)], "asset string")
    out = {(r.ts.day, r.asset): r.value for r in P.asof_signal(signal, cal, inst).collect()}
    assert [out[k, "a"] for k in range(1, 7)] == [0, 1, 1, 0.5, 0.5, 0.5]
    assert [out[k, "b"] for k in range(1, 7)] == [0, -1, -1, 0, 0, 0]
    one = P.asof_broadcast(signal.filter("asset = 'a'"), cal, inst).filter("asset = 'b'")
    assert by_ts(one, "value") == [0, 1, 1, 0.5, 0.5, 0.5]


def test_business_days(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(d,) for d in days], "d date")

    def step(d, n):
        while n:
            d += timedelta(days=1 if n > 0 else -1)
            n -= (1 if n > 0 else -1) * (d.weekday() < 5)
        return d

    for n in (1, 5, 7, 30, -1, -6):
        assert all(r.x == step(r.d, n) for r in df.select("d", D.add_business_days(F.col("d"), n).alias("x")).collect())


def test_vintages(spark):
    rows = [("x", date(2024, 1, 1), "2024-01-05", 1.0), ("x", date(2024, 1, 1), "2024-02-05", 2.0), ("x", date(2024, 1, 2), "2024-03-01", 9.0)]
    df = spark.createDataFrame(rows, "ticker string, obs_date date, r string, value double").withColumn("realtime_start", F.to_timestamp("r"))
    assert [r.close for r in L.vintage_as_of(df, "2024-01-15", "2024-01-01", "2024-12-31").collect()] == [1.0]
    assert [r.close for r in L.vintage_as_of(df, "2024-02-15", "2024-01-01", "2024-12-31").collect()] == [2.0]


def test_contract(spark):
    raw = spark.createDataFrame([(date(2024, 1, 1), 10, 11.0)], "ts date, CLOSE int, `Adj Close` double")
    out = L.normalise_contract(raw, "yahoo").collect()[0]
    assert (out.close, out.source) == (10.0, "yahoo")
    assert L.normalise_contract(raw.drop("CLOSE"), "yahoo").collect()[0].close == 11.0
    with pytest.raises(ValueError, match="no Close"):
        L.normalise_contract(raw.select("ts"), "yahoo")
    good = L.normalise_contract(raw, "yahoo")
    assert L.validate_series(good, ["source"]).count() == 0
    with pytest.raises(ValueError, match="missing"):
        L.validate_series(good.withColumn("close", F.lit(None).cast("double")), ["source"], strict=True)
    with pytest.raises(ValueError, match="double"):
        L.validate_series(good.withColumn("close", F.lit(1)), ["source"])
    with pytest.raises(ValueError):
        L.pick_value_column(spark.createDataFrame([(1, 2)], "a int, b int"))


def test_benchmark_align_and_strict_checks(spark, series):
    bench = series({"x": [0.1, 0.2, float("inf")]}).select("ts", F.col("value").alias("ret"))
    strat = series({"s": [1.0, None, 3.0], "t": [1.0, 2.0, 3.0]}).select("ts", F.col("asset").alias("config"), F.col("value").alias("ret"))
    assert sorted(r.config for r in P.benchmark_align(bench, strat).collect()) == ["s", "t"]
    with pytest.raises(ValueError, match="calendar"):
        P.check_test_dates(series({"x": [1.0]}, start=date(2025, 1, 1)), bench, strict=True)
    with pytest.raises(ValueError, match="base currency"):
        P.fx_pairs(spark.createDataFrame([("EUR",)], "ccy string"), "USD", strict=True)
    with pytest.raises(ValueError, match="missing price"):
        P.instrument_prices(series({"x": [1.0]}), spark.createDataFrame([("y",)], "asset string"), strict=True)
    with pytest.raises(ValueError, match="No overlapping"):
        P.calendar_union(series({"x": [1.0]}), "2030-01-01", "2030-12-31", strict=True)
