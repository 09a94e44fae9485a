import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochrone.operators import combine

START = date(2020, 1, 1)


def ics(spark, n, days, seed=0, missing=0.0, scope=None):
    rng = np.random.default_rng(seed)
    shared = rng.normal(0, 0.1, days)
    rows = []
    for i in range(n):
        x = 0.02 * (i + 1) + rng.normal(0, 0.1, days) + (shared if i < 2 else 0)
        rows += [(f"s{i}", START + timedelta(days=d), None if rng.random() < missing else float(x[d])) for d in range(days)]
    return rows, spark.createDataFrame(rows, "signal string, ts date, ic double")


def brute(rows, names, method, window, lag, shrink, least):
    days = sorted({r[1] for r in rows})
    at = {(r[0], r[1]): r[2] for r in rows}
    out = {}
    for d, day in enumerate(days):
        past = [[at.get((s, x)) for s in names] for x in days[max(0, d - window - lag + 1) : max(0, d - lag + 1)]]
        past = np.array([p for p in past if None not in p], float)
        w = np.full(len(names), 1 / len(names))
        if len(past) >= least and method != "equal":
            mean, cov = past.mean(axis=0), np.atleast_2d(np.cov(past.T))
            raw = mean / np.sqrt(np.diag(cov)) if method == "icir" else np.linalg.solve(cov * (1 - shrink) + np.diag(np.diag(cov)) * shrink, mean)
            w = raw / np.abs(raw).sum()
        out |= {(s, day): w[i] for i, s in enumerate(names)}
    return out


@pytest.mark.parametrize("n,method", [(1, "penalised"), (3, "icir"), (3, "equal"), (5, "penalised"), (8, "penalised")])
def test_weights_equal_brute_force(spark, n, method):
    rows, ic = ics(spark, n, 80, seed=n, missing=0.05)
    names = [f"s{i}" for i in range(n)]
    got = {(r["signal"], r["ts"]): r["weight"] for r in combine.signal_weights(ic, names, method, window=30, lag=3, shrink=0.3, least=15).collect()}
    want = brute(rows, names, method, 30, 3, 0.3, 15)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k
    days = sorted({k[1] for k in got})
    assert all(sum(abs(got[s, d]) for s in names) == pytest.approx(1) for d in days)


def test_correlated_signals_share_their_weight(spark):
    rows, ic = ics(spark, 3, 400, seed=3)
    twin = [("s3", ts, x) for s, ts, x in rows if s == "s2"]
    ic = ic.union(spark.createDataFrame(twin, ic.schema))
    last = START + timedelta(days=399)
    one = {r["signal"]: r["weight"] for r in combine.signal_weights(ic, ["s0", "s2", "s3"], "icir").filter(F.col("ts") == F.lit(last)).collect()}
    two = {r["signal"]: r["weight"] for r in combine.signal_weights(ic, ["s0", "s2", "s3"]).filter(F.col("ts") == F.lit(last)).collect()}
    assert two["s2"] == pytest.approx(two["s3"]) and two["s2"] / two["s0"] < one["s2"] / one["s0"]


def test_weights_do_not_look_ahead(spark):
    rows, ic = ics(spark, 3, 60, seed=5)
    names = ["s0", "s1", "s2"]
    cut = START + timedelta(days=50)
    changed = ic.withColumn("ic", F.when(F.col("ts") > F.lit(cut - timedelta(days=2)), F.lit(9.0)).otherwise(F.col("ic")))
    before = lambda df: sorted(map(tuple, combine.signal_weights(df, names, lag=2).filter(F.col("ts") <= F.lit(cut)).collect()))
    assert before(ic) == before(changed)


def test_constant_or_few_rows_give_equal_weights(spark):
    flat = spark.createDataFrame([(s, START + timedelta(days=d), 0.5) for s in ("a", "b") for d in range(40)], "signal string, ts date, ic double")
    for method in combine.METHODS:
        assert {r["weight"] for r in combine.signal_weights(flat, ["a", "b"], method).collect()} == {0.5}
    assert combine.signal_weights(flat.limit(0), ["a", "b"]).count() == 0


def test_scopes_are_apart_and_combined(spark):
    rows, ic = ics(spark, 2, 40, seed=7)
    _, other = ics(spark, 2, 40, seed=8)
    both = ic.withColumn("fold", F.lit(1)).union(other.withColumn("fold", F.lit(2)))
    weights = combine.signal_weights(both, ["s0", "s1"], scope=["fold"])
    alone = sorted(map(tuple, combine.signal_weights(ic, ["s0", "s1"]).collect()))
    assert sorted(map(tuple, weights.filter("fold = 1").drop("fold").collect())) == alone
    day = START + timedelta(days=30)
    signals = spark.createDataFrame([(1, "s0", day, "A", 1.0), (1, "s1", day, "A", -2.0), (1, "s0", day, "B", None), (1, "s1", day, "B", 3.0), (2, "s0", day, "C", None)], "fold int, signal string, ts date, asset string, value double")
    got = {(r["fold"], r["asset"]): r["value"] for r in combine.weighted_combination(signals, weights, ["fold"]).collect()}
    w = {a[0]: a[2] for a in alone if a[1] == day}
    assert got == {(1, "A"): pytest.approx(w["s0"] - 2 * w["s1"]), (1, "B"): pytest.approx(3 * w["s1"]), (2, "C"): None}


@pytest.mark.parametrize("options", [{"signals": []}, {"signals": [str(i) for i in range(9)]}, {"signals": ["a", "a"]}, {"signals": ["a"], "method": "best"}, {"signals": ["a"], "lag": 0}])
def test_refused_options(spark, options):
    with pytest.raises(ValueError):
        combine.signal_weights(spark.createDataFrame([], "signal string, ts date, ic double"), **options)


def test_solve_refuses_a_singular_matrix(spark):
    row = spark.range(1).select(combine.solve(F.array(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))), F.array(F.lit(1.0), F.lit(2.0)), 2).alias("x")).first()
    assert row["x"] is None
