"""Layered tables, ingestion and the catalogue."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from isochrone.functions.spark import shared_dir
from isochrone.sources import ingest as I
from isochrone.sources import landing as L
from isochrone.sources import layers as Y
from isochrone.sources import registry as R


@pytest.fixture
def store(spark):
    return Y.LayerStore(spark, shared_dir(spark, "test-layers"), buckets=2)


def _series(spark, ticker, first, last, source="yahoo", frequency="daily", price=100.0):
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    rows = [(source, ticker, frequency, d, price) for d in days if d.weekday() < 5]
    return spark.createDataFrame(rows, "source string, ticker string, frequency string, ts date, close double")


def test_raw_is_immutable(spark, store):
    a = _series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 10))
    store.write_raw(a)
    store.write_raw(_series(spark, "TLT", date(2024, 1, 1), date(2024, 1, 10)))
    with pytest.raises(ValueError, match="already exist"):
        store.write_raw(a)
    assert store.read("raw", F.col("ticker") == "SPY").count() == 8
    with pytest.raises(ValueError, match="close"):
        store.write_raw(a.drop("close"))


def test_missing_layer_is_not_a_broken_one(spark, store):
    assert not store.exists("raw")
    store.write_raw(_series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 3)).limit(0))
    assert not store.exists("raw")
    store.write_raw(_series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 3)))
    assert store.exists("raw") and store.read("raw", series="SPY").count() == 3 and store.read("raw", series="TLT").count() == 0
    with pytest.raises(ValueError, match="unknown layer"):
        store.exists("gold")


def test_versions_are_numeric(spark, store):
    a = _series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 10))
    for v in (1, 3, 2, 10):
        store.write_adjusted(a.withColumn("close", F.lit(float(v))), v)
    store.write_adjusted(_series(spark, "TLT", date(2024, 1, 1), date(2024, 1, 10)), 3)
    latest = {(r.ticker, r.close) for r in store.read("adjusted", version="latest").select("ticker", "close").distinct().collect()}
    assert latest == {("SPY", 10.0), ("TLT", 100.0)}
    store.write_adjusted(a.withColumn("close", F.lit(7.0)), 3)  # replaces SPY v3, keeps TLT v3
    assert {(r.ticker, r.close) for r in store.read("adjusted", version=3).select("ticker", "close").distinct().collect()} == {("SPY", 7.0), ("TLT", 100.0)}
    with pytest.raises(ValueError, match="version"):
        store.write_adjusted(a, -1)
    assert [(r.ticker, r.version, r.row_count) for r in store.list_available("adjusted").collect()][:2] == [("SPY", 1, 8), ("SPY", 2, 8)]


def test_derived_replace_and_missing(spark, store):
    d = spark.createDataFrame([("VOL", "daily", date(2024, 1, 1), 1.0)], "name string, frequency string, ts date, close double")
    store.write_derived(d)
    store.write_derived(d.withColumn("close", F.lit(2.0)))
    assert [r.close for r in store.read_derived("VOL", "daily").collect()] == [2.0]
    with pytest.raises(LookupError):
        store.read_derived("NOPE", "daily")


def test_parse_and_storage_lineage(spark):
    ids = [("raw", "yahoo_SPY_daily"), ("adjusted", "yahoo_SPY_daily_v10"), ("adjusted", "yahoo_SPY_daily_v2"), ("derived", "yahoo_SPY_VOL__ab_daily"),
           ("raw", "bad_key"), ("adjusted", "yahoo_SPY_daily"), ("derived", "yahoo_TLT_VOL_daily")]
    parsed = Y.parse_series_key(spark.createDataFrame(ids, "layer string, table_id string"))
    assert parsed.count() == 5
    row = Y.storage_lineage(parsed).collect()[0]
    assert (row.raw, row.adjusted_versions, row.derived) == ("yahoo_SPY_daily", [2, 10], ["yahoo_SPY_VOL__ab_daily"])


@pytest.mark.parametrize("frequency,last,covered", [
    ("monthly", date(2024, 11, 30), True), ("monthly", date(2024, 9, 30), False), ("quarterly", date(2024, 9, 30), True),
    ("daily", date(2024, 12, 30), True), ("daily", date(2024, 12, 20), False),
])
def test_coverage(spark, frequency, last, covered):
    key = ("s", "t", frequency)
    ranges = spark.createDataFrame([(*key, date(2009, 12, 31), last)], "source string, ticker string, frequency string, cached_start date, cached_end date")
    schema = "source string, ticker string, frequency string, start date, end date"
    asked = spark.createDataFrame([(*key, date(2010, 1, 1), date(2024, 12, 31))], schema)
    assert I.coverage_check(ranges, asked).collect()[0].covered is covered
    weekend = spark.createDataFrame([(*key, date(2024, 1, 6), date(2024, 1, 7))], schema)
    assert I.coverage_check(ranges, weekend).collect()[0].covered is True
    other = spark.createDataFrame([("s", "none", frequency, date(2024, 1, 6), date(2024, 1, 7))], schema)
    assert I.coverage_check(ranges, other).collect()[0].covered is False


def test_ingest_statuses(spark, store):
    lo, hi = date(2024, 1, 1), date(2024, 3, 29)
    store.write_raw(_series(spark, "COV", lo, hi).unionByName(_series(spark, "NAR", date(2023, 1, 2), date(2024, 2, 1))))
    gap = _series(spark, "GAP", lo, hi).withColumn("close", F.when(F.col("ts").between(date(2024, 2, 5), date(2024, 2, 9)), None).otherwise(F.col("close")))
    landing = _series(spark, "NEW", lo, hi).unionByName(gap).unionByName(_series(spark, "NAR", lo, hi))
    asked = spark.createDataFrame([("yahoo", t, "daily", lo, hi) for t in ("COV", "NEW", "GAP", "NAR", "ABSENT")], "source string, ticker string, frequency string, start date, end date")
    got = {r.ticker: r.status for r in I.incremental_ingest(store, landing, asked).collect()}
    assert got == {"COV": "covered", "NEW": "stored", "GAP": "raw_only", "NAR": "rejected", "ABSENT": "no_data"}
    assert {r.ticker for r in store.read("adjusted").select("ticker").distinct().collect()} == {"NEW"}
    assert store.read("raw", F.col("ticker") == "NAR").agg(F.min("ts")).collect()[0][0] == date(2023, 1, 2)
    again = {r.ticker: r.status for r in I.incremental_ingest(store, landing, asked.filter("ticker = 'NEW'")).collect()}
    assert again == {"NEW": "covered"}


def test_overlapping_requests_store_each_row_once(spark, store):
    landing = _series(spark, "NEW", date(2024, 1, 1), date(2024, 3, 29))
    asked = spark.createDataFrame([("yahoo", "NEW", "daily", a, b) for a, b in ((date(2024, 1, 1), date(2024, 2, 15)), (date(2024, 2, 1), date(2024, 2, 20)), (date(2024, 1, 1), date(2024, 2, 15)))], "source string, ticker string, frequency string, start date, end date")
    assert {r.status for r in I.incremental_ingest(store, landing, asked).collect()} == {"stored"}
    for layer in ("raw", "adjusted"):
        rows = store.read(layer).filter("ticker = 'NEW'")
        assert rows.count() == rows.select("ts").distinct().count() == landing.filter("ts <= date '2024-02-20'").count()


def test_key_hygiene(spark):
    t = spark.createDataFrame([("EURUSD=X",), ("BRK-B",), ("BRK.B",), ("^GSPC",)], "ticker string")
    assert {r.k for r in t.select(L.sanitise_key(F.col("ticker")).alias("k")).collect()} == {"EURUSD_X", "BRK_B", "_GSPC"}
    assert [(r.store_key, r.n_tickers) for r in L.key_collisions(t).collect()] == [("BRK_B", 2)]
    v = spark.createDataFrame([("a", "FRED", "S1", None), ("b", "Yahoo", None, None)], "name string, source string, series_id string, ticker string")
    with pytest.raises(ValueError, match="without a route"):
        L.route_source(v, strict=True)


CHAIN = [("T", "R"), ("D", "T"), ("D2", "T")]


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def _vars(spark, names):
    return spark.createDataFrame([(n, layer) for n, layer in names], "name string, layer string")


def test_catalogue_graph(spark):
    e = _edges(spark, CHAIN)
    v = _vars(spark, [("R", "raw"), ("T", "transformed"), ("D", "derived"), ("D2", "derived")])
    assert {(r.name, r.user) for r in R.used_by(e).collect()} == {("R", "T"), ("T", "D"), ("T", "D2")}
    assert {(r.name, r.user) for r in R.used_by_transitive(e).collect()} == {("R", "T"), ("R", "D"), ("R", "D2"), ("T", "D"), ("T", "D2")}
    tree = {tuple(r.path): r.depth for r in R.variable_lineage(e, v).filter("root = 'D'").collect()}
    assert tree == {("D",): 0, ("D", "T"): 1, ("D", "T", "R"): 2}
    assert R.dependency_cycles(e).count() == 0
    assert [r.dst for r in R.unresolved_refs(_edges(spark, [("A", "B"), ("A", "R")]), v).collect()] == ["B"]
    assert [r.name for r in R.filter_layer(v, "raw").collect()] == ["R"]
    with pytest.raises(ValueError):
        R.filter_layer(v, "gold")
    with pytest.raises(ValueError, match="unknown variables"):
        R.registry_lookup(v, _vars(spark, [("X", "raw")]), strict=True)


def test_cycles(spark):
    rows = [("A", "B"), ("B", "A"), ("C", "A"), ("B", "D"), ("E", "E"), ("F", "G"), ("A", "M"), ("M", "X"), ("X", "Y"), ("Y", "X")]
    assert {r.name for r in R.dependency_cycles(_edges(spark, rows)).collect()} == {"A", "B", "E", "X", "Y"}
    looped = R.variable_lineage(_edges(spark, [("A", "B"), ("B", "A")]), _vars(spark, [("A", "raw"), ("B", "raw")]))
    assert looped.count() == 4


def test_edges_and_universe(spark):
    specs = spark.createDataFrame([("a", "x", None, None), ("b", None, ["x", "y"], ["z"]), ("c", None, None, None)], "name string, source_variable string, sources array<string>, inputs array<string>")
    assert sorted((r.src, r.dst) for r in R.dependency_edges(specs).collect()) == [("a", "x"), ("b", "x"), ("b", "y"), ("b", "z")]
    template = spark.createDataFrame([("u", "{ticker}_CLOSE"), ("w", "SAME")], "universe string, pattern string")
    tickers = spark.createDataFrame([("u", "AAPL"), ("u", "MSFT")], "universe string, ticker string")
    assert {r.name for r in R.universe_expand(template, tickers).collect()} == {"AAPL_CLOSE", "MSFT_CLOSE"}
    with pytest.raises(ValueError, match="collide"):
        R.universe_expand(template, tickers.withColumn("universe", F.lit("w")), strict=True)


def test_spec_hash_is_canonical_json(spark):
    import hashlib
    import json

    spec = {"transformation": "rolling_vol", "source_variable": "TLT_LOG_RET", "window": 63, "annualised": True, "frequency": "daily", "source_frequency": "daily"}
    df = spark.createDataFrame([("V", *spec.values())], "name string, transformation string, source_variable string, window int, annualised boolean, frequency string, source_frequency string")
    want = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()[:8]
    row = R.spec_hash(df).collect()[0]
    assert row.spec_hash == want and row.derived_id == f"V__{want}_daily"
    pair = {"transformation": "difference", "sources": ["A", "B"], "frequency": None, "source_frequency": "daily"}
    df = spark.createDataFrame([("W", "difference", ["A", "B"], None, "daily")], "name string, transformation string, sources array<string>, frequency string, source_frequency string")
    assert R.spec_hash(df).collect()[0].spec_hash == hashlib.sha256(json.dumps(pair, sort_keys=True).encode()).hexdigest()[:8]


def test_derived_cache_hits_only_when_covering(spark, store, series):
    calls = []

    def compute():
        calls.append(1)
        return series({"a": range(60)}).withColumnRenamed("value", "close")

    args = (store, "V__ab", "daily")
    assert R.derived_cache(*args, "2024-01-05", "2024-02-10", compute)[1] is False
    rows, hit = R.derived_cache(*args, "2024-01-10", "2024-01-12", compute)
    assert hit and rows.count() == 3 and len(calls) == 1
    rows, hit = R.derived_cache(*args, "2024-01-01", "2024-02-10", compute)
    assert not hit and rows.count() == 41 and len(calls) == 2
    stale = R.stale_derived(spark.createDataFrame([("V", "old"), ("V", "new"), ("Z", "q")], "name string, spec_hash string"), spark.createDataFrame([("V", "new")], "name string, spec_hash string"))
    assert [(r.name, r.spec_hash) for r in stale.collect()] == [("V", "old")]


def test_failed_write_loses_nothing(spark, store):
    a = _series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 10)).unionByName(_series(spark, "TLT", date(2024, 1, 1), date(2024, 1, 10)))
    store.write_raw(a)
    broken = a.filter("ticker = 'SPY'").withColumn("close", F.when(F.col("ts") < date(2024, 1, 9), 1.0).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        store.replace_raw(broken)
    assert {(r.ticker, r.close, r.n) for r in store.read("raw").groupBy("ticker", "close").agg(F.count("*").alias("n")).collect()} == {("SPY", 100.0, 8), ("TLT", 100.0, 8)}
    with pytest.raises(ValueError, match="full key"):
        store.replace_raw(a.withColumn("ticker", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="stored as double"):
        store.replace_raw(a.withColumn("close", F.lit("1")))
    assert store.list_available("raw").count() == 2


def test_second_writer_is_refused(spark, store):
    a = _series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 10))
    store.write_raw(a)
    before = store._state("raw")
    store.replace_raw(a.withColumn("close", F.lit(2.0)))
    other = Y.LayerStore(spark, store.root, buckets=5)
    other._state = lambda layer: before
    with pytest.raises(Y.ConflictError):
        other.replace_raw(a.withColumn("close", F.lit(3.0)))
    del other._state
    assert {r.close for r in store.read("raw").collect()} == {2.0}
    other.replace_raw(a.withColumn("close", F.lit(3.0)))
    # bucket counts may differ between writers: the manifest knows each series' own
    assert [r.close for r in store.read("raw", series="SPY").collect()] == [3.0] * 8
    assert len(store.clean_up("raw")) == 2 and store.clean_up("raw") == []
    assert [r.close for r in store.read("raw").collect()] == [3.0] * 8
    with pytest.raises(ValueError, match="already exist"):
        store.write_raw(a)


def test_replacing_reads_manifest_and_new_files_only(spark, store):
    store.write_raw(_series(spark, "SPY", date(2024, 1, 1), date(2024, 1, 10)))
    store.write_raw(_series(spark, "TLT", date(2024, 1, 1), date(2024, 1, 10), source="fred"))
    data = f"{store.path('raw')}/data"
    files = set(spark.read.parquet(data).inputFiles())
    held = store.series("raw")
    assert {(r.ticker, r.first, r.last, r.row_count) for r in held.collect()} == {("SPY", date(2024, 1, 1), date(2024, 1, 10), 8), ("TLT", date(2024, 1, 1), date(2024, 1, 10), 8)}
    assert not any("/data/" in f for f in held.inputFiles())
    store.replace_raw(_series(spark, "SPY", date(2023, 12, 1), date(2024, 1, 10)).withColumn("extra", F.lit(1)))
    assert files < set(spark.read.parquet(data).inputFiles())
    got = {(r.ticker, r.extra, r.n) for r in store.read("raw").groupBy("ticker", "extra").agg(F.count("*").alias("n")).collect()}
    assert got == {("SPY", 1, 29), ("TLT", None, 8)}
    assert {f.split("generation=")[1][:12] for f in store.read("raw", series="TLT").inputFiles()} == {"000000000001"}
