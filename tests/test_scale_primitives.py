"""The split forms of windows and rankings equal the plain ones and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import by_ts
from isochrone.operators import cross, series as S
from isochrone.operators.portfolio import gross_limit, net_limit


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1000])
def test_blocked_rolling_equals_plain(series, block_rows):
    rng = random.Random(block_rows)
    xs = {k: [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(40)] for k in "ab"}
    df = series(xs, hourly=True)
    plain = Window.partitionBy("asset").orderBy("ts")

    def build(w):
        return {"m": S.rolling_mean(F.col("value"), w, 5), "l": F.lag("value", 3).over(w), "f": F.lead("value", 4).over(w)}

    got = S.with_windows(df, ["asset"], build, before=4, after=4, block_rows=block_rows)
    want = df.withColumns(build(plain))
    assert got.count() == 80
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_positions_across_spans(spark, series):
    df = series({"a": range(100), "b": range(3)}, hourly=True)
    out = S.with_positions(df, ["asset"], span="day")
    assert out.filter(F.col("pos") != F.col("value")).count() == 0


@pytest.mark.parametrize("kind", ["sum", "max", "min", "product", "last"])
def test_running_in_spans_equals_plain(series, kind):
    rng = random.Random(5)
    xs = {k: [1.0 + 0.01 * rng.gauss(0, 1) if kind == "product" or rng.random() > 0.3 else None for _ in range(90)] for k in "ab"}
    df = series(xs, hourly=True)
    x = F.coalesce("value", F.lit(0.0)) if kind == "sum" else F.col("value")
    split = S.running(df, ["asset"], {"r": (kind, x)}, span="day")
    whole = Window.partitionBy("asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("r", S._running_over(kind, x, whole))
    a, b = by_ts(split, "r", "asset"), by_ts(plain, "r", "asset")
    assert all((p is None and q is None) or math.isclose(p, q, rel_tol=1e-12) for p, q in zip(a, b, strict=True))


def _cross(spark, n=60):
    rng = random.Random(3)
    rows = []
    for day in range(3):
        for i in range(n):
            v = rng.choice([None, 0.0, -1.5, 2.0, rng.gauss(0, 1), rng.gauss(0, 1) * 1e6, -1e-9])
            rows.append((day, i, v))
    # one value shared by most rows of a date: the case that must not end in one task
    rows += [(9, i, 0.0) for i in range(200)] + [(9, 200 + i, float(i)) for i in range(5)]
    return spark.createDataFrame(rows, "ts int, asset long, value double").filter("value is null or value = value")


def test_rank_two_level_equals_window_and_numpy(spark):
    df = _cross(spark)
    plain = cross.rank_within(df, ["ts"], "value", "r", bound=1000, size="n")
    split = cross.rank_within(df, ["ts"], "value", "r", size="n")
    assert plain.exceptAll(split.select(plain.columns)).count() == 0
    for day, rows in split.toPandas().groupby("ts"):
        v = rows.value.to_numpy()
        for x, r in zip(v, rows.r):
            if not np.isnan(x):
                assert r == (v < x).sum() + ((v == x).sum() + 1) / 2


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("tie", ["asset", "name"])
def test_order_two_level_equals_window(spark, ascending, tie):
    df = _cross(spark).withColumn("name", F.concat(F.lit("asset"), F.col("asset").cast("string")))
    plain = cross.order_within(df, ["ts"], "value", tie, "o", before="b", ascending=ascending, bound=1000)
    split = cross.order_within(df, ["ts"], "value", tie, "o", before="b", ascending=ascending)
    a = plain.filter("value is not null").orderBy("ts", "asset").toPandas()
    b = split.filter("value is not null").orderBy("ts", "asset").toPandas()
    assert a.o.tolist() == b.o.tolist()
    assert np.allclose(a.b, b.b, rtol=1e-9, atol=1e-6)
    assert split.filter("value is null and o is not null").count() == 0


def test_value_buckets_keep_order(spark):
    xs = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, 1.0000001, 5.0, -3.0, -3.1, 1e12, -1e12])
    rows = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("b", cross.value_bucket(F.col("x"))).collect()
    buckets = [tuple(r.b) for r in sorted(rows, key=lambda r: r.x)]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("bound", [None, 100])
def test_median(spark, bound):
    df = _cross(spark)
    got = {r.ts: r.m for r in cross.median_within(df, ["ts"], "value", "asset", "m", bound).collect()}
    want = df.filter("value is not null").toPandas().groupby("ts").value.median()
    assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items())


@pytest.mark.parametrize("bound", [None, 100])
def test_cross_ic_guards(spark, bound):
    rows = [(1, i, float(i), float(i * i)) for i in range(6)] + [(2, i, 1.0, float(i)) for i in range(4)] + [(3, 0, 1.0, 1.0)]
    rows += [(4, i, float(i), float(-i)) for i in range(5)]
    df = spark.createDataFrame(rows, "ts int, asset int, x double, y double")
    got = {r.ts: r.ic for r in cross.cross_ic(df, ["ts"], "x", "y", bound=bound).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: -1.0}


def _greedy(row, limit):
    w = list(row)
    net = sum(w)
    side = 1.0 if net > 0 else -1.0
    rest = max(abs(net) - limit, 0.0)
    for i in sorted((i for i in range(len(w)) if w[i] * side > 0), key=lambda i: (-abs(w[i]), -i)):
        cut = min(abs(w[i]), rest)
        w[i] -= side * cut
        rest -= cut
    return w


@pytest.mark.parametrize("bound", [None, 100])
def test_net_limit_greedy(spark, bound):
    rng = random.Random(1)
    grid = [[0.0] * 5, [0.01, 0.02, 0.03, -0.05, 0.0], [0.5, 0.5, 0.5, 0.5, -0.1], [-0.4, -0.4, 0.1, 0.0, -0.2], [1.0, 0.3, 0.3, 0.3, 0.05]]
    grid += [[rng.uniform(-0.3, 1.0) for _ in range(5)] for _ in range(10)]
    df = spark.createDataFrame([(t, i, w) for t, row in enumerate(grid) for i, w in enumerate(row)], "ts int, asset long, weight double")
    got = net_limit(df, 0.10, bound=bound).toPandas().pivot(index="ts", columns="asset", values="weight").to_numpy()
    assert np.allclose(got, [_greedy(r, 0.10) for r in grid], atol=1e-12)
    assert net_limit(df, float("inf")) is df
    with pytest.raises(ValueError):
        net_limit(df, -1.0)


@pytest.mark.parametrize("bound", [None, 100])
def test_gross_limit(spark, bound):
    df = spark.createDataFrame([(0, 0, 3.0), (0, 1, -1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.0), (2, 1, 0.0)], "ts int, asset int, weight double")
    got = {(r.ts, r.asset): r.weight for r in gross_limit(df, 2.0, bound=bound).collect()}
    assert got == {(0, 0): 1.5, (0, 1): -0.5, (1, 0): 0.5, (1, 1): 0.5, (2, 0): 0.0, (2, 1): 0.0}


def test_trailing_moments_do_not_slide(spark):
    """Equal to the sliding frame, and no sliding frame in the plan."""
    import random

    from isochrone.operators.clean import flag_outliers
    from isochrone.operators.series import rolling_mean, rolling_std, trailing_moments, with_windows

    rng = random.Random(4)
    values = [(a, i, None if rng.random() < 0.02 else 0.1 if 40 <= i < 60 else 1e6 + rng.random()) for a, n in (("x", 90), ("y", 7), ("z", 8)) for i in range(n)]
    rows = spark.createDataFrame(values, "asset string, i int, value double")
    for kind in ("date", "timestamp"):
        df = rows.selectExpr("asset", f"CAST(date_add(DATE '2024-01-01', i) AS {kind.upper()}) AS ts", "value")
        x = F.col("value")
        got = trailing_moments(df, ["asset"], "value", 8, "m", "s")
        both = with_windows(got, ["asset"], lambda w: {"rm": rolling_mean(x, w, 8), "rs": rolling_std(x, w, 8)}, before=7)
        found = both.collect()
        assert len(found) == len(values) and got.columns == [*df.columns, "m", "s"]
        assert sum(r["m"] is not None for r in found) > 40
        for r in found:
            assert (r["m"] is None) == (r["rm"] is None) and (r["s"] is None) == (r["rs"] is None)
            if r["m"] is not None:
                assert abs(r["m"] - r["rm"]) <= 1e-12 * abs(r["rm"]) and abs(r["s"] - r["rs"]) <= 1e-7 * r["rs"]
        plan = flag_outliers(df, value="value")._jdf.queryExecution().executedPlan().toString()
        assert "RowFrame, -251" not in plan.replace("-251, -251", "")
