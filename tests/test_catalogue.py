from datetime import date, timedelta

import pytest

from isochrone.functions.spark import shared_dir
from isochrone.sources import catalogue as C
from isochrone.sources import ingest, layers

START = date(2024, 1, 1)


def landing(spark, tickers=("A", "B"), days=60, frequency="daily"):
    rows = [("vendor", t, frequency, START + timedelta(days=i), float(100 + i + 7 * n + (i * i) % 5)) for n, t in enumerate(tickers) for i in range(days)]
    return spark.createDataFrame(rows, "source string, ticker string, frequency string, ts date, close double")


def raw(name, ticker, frequency="daily", source="Vendor"):
    return (name, "raw", source, None, ticker, frequency, frequency, None, None, None, None, None)


def made(name, transformation, source=None, sources=None, window=None, annualised=None, frequency="daily"):
    return (name, "transformed", None, None, None, frequency, frequency, transformation, source, sources, window, annualised)


def catalogue(spark, specs, land=None):
    store = layers.LayerStore(spark, shared_dir(spark, "layers"), buckets=2)
    return C.Catalogue(spark, store, spark.createDataFrame(specs, C.SPEC), landing(spark) if land is None else land)


CHAIN = [raw("A_CLOSE", "A"), raw("B_CLOSE", "B"), made("A_RET", "log_return", "A_CLOSE", window=1), made("B_RET", "log_return", "B_CLOSE", window=1),
    made("GAP", "difference", sources=["A_RET", "B_RET"]), made("VOL", "rolling_vol", "GAP", window=5, annualised=True), ("MODEL", "derived", *[None] * 3, "daily", *[None] * 6)]


def rows(df):
    return {(r["asset"], r["ts"]): r["value"] for r in df.collect()}


def test_chain_is_computed_level_by_level_and_kept(spark, monkeypatch):
    names, calls = catalogue(spark, CHAIN), []
    plain = C.Catalogue._transformed
    monkeypatch.setattr(C.Catalogue, "_transformed", lambda self, specs, values, p: calls.append(p["transformation"]) or plain(self, specs, values, p))
    assert {r["name"]: r["level"] for r in names.plan(["VOL"]).collect()} == {"A_CLOSE": 0, "B_CLOSE": 0, "A_RET": 1, "B_RET": 1, "GAP": 2, "VOL": 3}
    end = START + timedelta(days=49)
    got = rows(names.get(["VOL", "A_RET"], START, end))
    # both returns of a level share one computation
    assert calls == ["log_return", "difference", "rolling_vol"]
    assert len(got) == 100 and {k[0] for k in got} == {"VOL", "A_RET"}
    import math
    import statistics

    close = {(r["ticker"], r["ts"]): r["close"] for r in landing(spark).collect()}
    day = [START + timedelta(days=i) for i in range(50)]
    ret = {t: [None, *[math.log(close[t, day[i]] / close[t, day[i - 1]]) for i in range(1, 50)]] for t in "AB"}
    gap = [None if a is None else a - b for a, b in zip(ret["A"], ret["B"], strict=True)]
    for i in range(50):
        assert got["A_RET", day[i]] == pytest.approx(ret["A"][i])
        want = None if i < 5 else statistics.stdev(gap[i - 4 : i + 1]) * math.sqrt(252)
        assert got["VOL", day[i]] == (None if want is None else pytest.approx(want))
    # within the range: from the derived layer; beyond it: computed again
    assert rows(names.get(["VOL"], START + timedelta(days=10), end)).items() <= got.items() and len(calls) == 3
    names.get(["GAP"], START, end + timedelta(days=5))
    assert len(calls) == 5
    names.get(["GAP"], START, end + timedelta(days=6), force_refresh=True)
    assert len(calls) == 7
    # a refresh may replace stored rows only by a range that contains theirs
    with pytest.raises(ValueError, match="rejected"):
        names.get(["A_CLOSE"], START, end, force_refresh=True)


def test_changed_spec_is_computed_again(spark):
    names = catalogue(spark, [raw("A_CLOSE", "A"), made("X", "log_return", "A_CLOSE", window=1)])
    one = rows(names.get(["X"], START, START + timedelta(days=20)))
    again = C.Catalogue(spark, names.store, spark.createDataFrame([raw("A_CLOSE", "A"), made("X", "log_return", "A_CLOSE", window=3)], C.SPEC), names.landing)
    two = rows(again.get(["X"], START, START + timedelta(days=20)))
    assert one["X", START + timedelta(days=2)] is not None and two["X", START + timedelta(days=2)] is None
    assert names.store.read("derived").select("name").distinct().count() == 2


@pytest.mark.parametrize("specs,name,message", [
    (CHAIN, "NONE", "unknown variables"), (CHAIN, "MODEL", "does not compute"), ([raw("A", "A", source=None)], "A", "without a route"), ([raw("A", "ZZZ")], "A", "cannot be served"),
    ([made("X", "log_return", "Y", window=1), made("Y", "log_return", "X", window=1), raw("A", "A")], "X", "cycle"),
    ([raw("A", "A", "monthly"), made("X", "log_return", "A", window=1)], "X", "another frequency"), ([raw("A", "A"), made("X", "magic", "A")], "X", "unknown transformations"),
    ([raw("A", "A"), made("X", "difference", sources=["A"])], "X", "two sources"), ([raw("A", "A"), made("X", "log_return", "NONE", window=1)], "X", "unknown variables"),
])
def test_reads_that_are_refused(spark, specs, name, message):
    with pytest.raises(ValueError, match=message):
        names = catalogue(spark, specs)
        names.plan([name])
        names.get([name], START, START + timedelta(days=20))


def test_duplicate_names_are_refused(spark):
    with pytest.raises(ValueError, match="defined twice"):
        catalogue(spark, [raw("A", "A"), raw("A", "B")])


def test_finer_and_coarser_frequencies(spark):
    months = [date(2023, 12, 31), date(2024, 1, 31), date(2024, 2, 29)]
    slow = spark.createDataFrame([("vendor", "M", "monthly", d, float(i)) for i, d in enumerate(months)], "source string, ticker string, frequency string, ts date, close double")
    names = catalogue(spark, [raw("M", "M", "monthly"), raw("A", "A")], slow.unionByName(landing(spark)))
    got = rows(names.get(["M", "A"], START, date(2024, 2, 29), "daily"))
    # the print before the start is loaded too, so no day is missing
    assert got["M", date(2024, 1, 1)] == 0.0 and got["M", date(2024, 1, 30)] == 0.0 and got["M", date(2024, 1, 31)] == 1.0
    assert got["A", date(2024, 1, 2)] == 102.0
    coarse = rows(names.get(["A"], START, date(2024, 2, 29), "monthly"))
    assert coarse == {("A", date(2024, 1, 31)): 100 + 30 + 0.0, ("A", date(2024, 2, 29)): 100 + 59 + (59 * 59) % 5}


def test_levels_of_a_diamond_stay_small(spark):
    """A path for every choice of a side, one row per name."""
    edges = [(f"t{i}", f"{side}{i}") for i in range(20) for side in "lr"] + [(f"{side}{i}", f"t{i + 1}") for i in range(20) for side in "lr"]
    table = spark.createDataFrame([*edges, ("other", "t3")], "src string, dst string").cache()
    names = C.reachable(table, spark.createDataFrame([("t16",)], "name string"))
    assert {r["name"] for r in names.collect()} == {f"t{i}" for i in range(16, 21)} | {f"{s}{i}" for i in range(16, 20) for s in "lr"}
    assert {r["name"]: r["level"] for r in C.dependency_levels(table, names).filter("name LIKE 't%'").collect()} == {f"t{i}": 2 * (20 - i) for i in range(16, 21)}


def test_fetch_or_load_layers(spark):
    store = layers.LayerStore(spark, shared_dir(spark, "layers"), buckets=2)
    asked = spark.createDataFrame([("vendor", "A", "daily", START, START + timedelta(days=30)), ("vendor", "A", "daily", START + timedelta(days=5), START + timedelta(days=10))], "source string, ticker string, frequency string, start date, end date")
    got = ingest.fetch_or_load(store, landing(spark), asked)
    assert got.count() == 31 and got.select("ticker").distinct().count() == 1
    clean = ingest.fetch_or_load(store, landing(spark).limit(0), asked, layer="adjusted")
    assert clean.count() == 31 and {"fill_type", "is_outlier", "clean_version"} <= set(clean.columns)
    with pytest.raises(ValueError, match="raw or the adjusted"):
        ingest.fetch_or_load(store, landing(spark), asked, layer="derived")
    other = asked.limit(1).selectExpr("source", "'ZZ' AS ticker", "frequency", "start", "end")
    assert ingest.fetch_or_load(store, landing(spark), other).count() == 0
    with pytest.raises(ValueError, match="cannot be served"):
        ingest.fetch_or_load(store, landing(spark), other, strict=True)
