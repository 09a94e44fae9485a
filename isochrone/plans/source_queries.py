"""Landing, layers, ingestion and the variable catalogue.

Store queries write driver-table series into a fresh folder of the shared directory and return what
is read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spark import shared_dir
from ..operators import backtest as B
from ..operators import transforms as T
from ..sources import catalogue as C
from ..sources import ingest as I
from ..sources import landing as L
from ..sources import layers as Y
from ..sources import registry as R
from . import panels as S
from .panels import ctes, edge, rnd_sql, sday, sts
from .registry import query

STORE_SERIES = ("st", "SELECT CASE WHEN asset % 3 = 0 THEN 'alpha' ELSE 'beta' END AS source, 'S' || asset AS ticker, 'daily' AS frequency, ts, value AS close FROM supp_d")


def store_series(spark, sf):
    """Daily supplier prices as stored series of two sources, one three times the other."""
    return S.supp_d(spark, sf).select(
        F.when(F.col("asset") % 3 == 0, "alpha").otherwise("beta").alias("source"), F.concat(F.lit("S"), F.col("asset").cast("string")).alias("ticker"),
        F.lit("daily").alias("frequency"), "ts", F.col("value").alias("close"))


def new_store(spark):
    return Y.LayerStore(spark, shared_dir(spark, "layers"), buckets=4)


# --- landing ----------------------------------------------------------------------------------

@query("scan_series", ctes("prio_d") + f"SELECT {sts('CAST(ts AS TIMESTAMP)', 'timestamp')}, asset, value AS close FROM prio_d WHERE asset = '2-HIGH' AND ts >= DATE '1998-01-01'")
def scan_series(spark, sf):
    path = shared_dir(spark, "landed")
    p = S.prio_d(spark, sf).select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("close"), F.lit(None).cast("string").alias("fill_type"),
        F.lit(False).alias("is_outlier"), F.lit(1).alias("clean_version"), "asset")
    p.write.partitionBy("asset").option("header", True).csv(path)
    where = (F.col("asset") == "2-HIGH") & (F.col("timestamp") >= F.lit("1998-01-01").cast("timestamp"))
    return edge(L.scan_series(spark, path, "csv", L.LANDED_SCHEMA + ", asset string", where, ordered=True), "timestamp", "asset", "close", exact=("close",))


@query("normalise_contract", f"SELECT o_orderkey, {sts('o_orderdate', 'timestamp')}, o_totalprice AS close, 'orders' AS source FROM orders")
def normalise_contract(spark, sf):
    raw = S.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("string").alias("Close"), F.lit(0.0).alias("Adj Close"))
    return edge(L.normalise_contract(raw, "orders", "o_orderdate", ("o_orderkey",)), exact=("close",))


@query("validate_series", "SELECT user_id, count(*) AS n_rows, sum(CASE WHEN value < 1.0 OR props IS NULL THEN 1 ELSE 0 END)::BIGINT AS bad_rows FROM events GROUP BY 1 HAVING sum(CASE WHEN value < 1.0 OR props IS NULL THEN 1 ELSE 0 END) > 0")
def validate_series(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("timestamp"), F.when(F.col("value") >= 1.0, F.col("value")).alias("close"), "props")
    return L.validate_series(e, ["user_id"])


@query("vintage_as_of", ctes("vintages") + f"SELECT ticker, {sday('obs_date')}, arg_max(value, (realtime_start, event_id)) + 0.0 AS close FROM vintages WHERE realtime_start <= TIMESTAMP '2024-01-20 12:00:00' AND obs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY 1, obs_date")
def vintage_as_of(spark, sf):
    return edge(L.vintage_as_of(S.vintages(spark, sf), "2024-01-20 12:00:00", "2024-01-03", "2024-01-25", tie="event_id"), exact=("close",))


@query("pick_value_column", "SELECT o_orderkey AS asset, o_totalprice AS value FROM orders")
def pick_value_column(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset"), F.col("o_totalprice").alias("close"), F.lit(1.0).alias("value"), F.lit("x").alias("note"))
    return edge(L.pick_value_column(o), exact=("value",))


_TICKER = "p_brand || (CASE WHEN p_size % 2 = 0 THEN '=' ELSE '-' END) || p_type || '.' || p_size"


@query("sanitise_key", f"SELECT replace(replace({_TICKER}, '=', '_'), '-', '_') AS k0, count(DISTINCT {_TICKER}) AS n_tickers, replace(replace(replace({_TICKER}, '=', '_'), '-', '_'), '.', '_') AS store_key FROM part GROUP BY 1, 3".replace("replace(replace(" + _TICKER + ", '=', '_'), '-', '_') AS k0, ", "").replace("GROUP BY 1, 3", "GROUP BY 2"))
def sanitise_key(spark, sf):
    t = S.table(spark, sf, "part").select(F.expr(_TICKER.replace("p_size)", "p_size)")).alias("ticker")).distinct()
    return t.withColumn("store_key", L.sanitise_key(F.col("ticker"))).groupBy("store_key").agg(F.count(F.lit(1)).alias("n_tickers"))


_PLAIN = "p_brand || '-' || p_type || (CASE WHEN p_size % 2 = 0 THEN '.A' ELSE '^A' END)"


@query("key_collisions", f"SELECT replace(replace(replace({_PLAIN}, '-', '_'), '.', '_'), '^', '_') AS store_key, count(DISTINCT {_PLAIN}) AS n_tickers FROM part GROUP BY 1 HAVING count(DISTINCT {_PLAIN}) > 1")
def key_collisions(spark, sf):
    return L.key_collisions(S.table(spark, sf, "part").select(F.expr(_PLAIN).alias("ticker")))


@query("route_source", "SELECT s_name AS name, CASE WHEN s_acctbal < 3000 THEN 'fred' ELSE 'yahoo' END AS source_key, CASE WHEN s_acctbal < 3000 THEN 'SER' || s_suppkey ELSE 'TKR' || s_suppkey END AS vendor_id FROM supplier")
def route_source(spark, sf):
    low = F.col("s_acctbal") < 3000
    key = F.col("s_suppkey").cast("string")
    v = S.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(low, "FRED").otherwise("Yahoo").alias("source"),
        F.when(low, F.concat(F.lit("SER"), key)).alias("series_id"), F.concat(F.lit("TKR"), key).alias("ticker"))
    return L.route_source(v).select("name", "source_key", "vendor_id")


# --- layers -----------------------------------------------------------------------------------

_READ = "SELECT source, ticker, frequency, {d}, close FROM st"


@query("write_raw", ctes("supp_d", STORE_SERIES) + _READ.format(d=sday()))
def write_raw(spark, sf):
    """Two appends of disjoint series; a repeated one is refused."""
    store, series = new_store(spark), store_series(spark, sf)
    store.write_raw(series.filter("source = 'alpha'"))
    store.write_raw(series.filter("source = 'beta'"))
    try:
        store.write_raw(series.filter("source = 'beta'"))
    except ValueError:
        return edge(store.read("raw"), "source", "ticker", "frequency", "ts", "close", exact=("close",))
    raise AssertionError("a stored raw series was written twice")


_VERSIONS = ("vs", "SELECT *, 1 AS version, close AS v FROM st UNION ALL SELECT *, 3, close * 3 FROM st WHERE source = 'alpha' UNION ALL SELECT *, 2, close * 2 FROM st UNION ALL SELECT *, 10, close * 10 FROM st WHERE ticker < 'S5'")


def versioned_store(spark, sf):
    store, series = new_store(spark), store_series(spark, sf)
    store.write_adjusted(series.withColumn("close", F.lit(0.0)), 1)
    store.write_adjusted(series, 1)  # replaces the zeros
    store.write_adjusted(series.filter("source = 'alpha'").withColumn("close", F.col("close") * 3), 3)
    store.write_adjusted(series.withColumn("close", F.col("close") * 2), 2)
    store.write_adjusted(series.filter("ticker < 'S5'").withColumn("close", F.col("close") * 10), 10)
    return store


@query("write_adjusted_version", ctes("supp_d", STORE_SERIES, _VERSIONS) + f"SELECT source, ticker, frequency, version, {sday()}, v AS close FROM vs")
def write_adjusted_version(spark, sf):
    return edge(versioned_store(spark, sf).read("adjusted"), "source", "ticker", "frequency", "version", "ts", "close", exact=("close",))


@query("latest_version", ctes("supp_d", STORE_SERIES, _VERSIONS, ("lv", "SELECT source, ticker, max(version) AS version FROM vs GROUP BY 1, 2")) + f"SELECT source, ticker, version, {sday()}, v AS close FROM vs JOIN lv USING (source, ticker, version)")
def latest_version(spark, sf):
    return edge(versioned_store(spark, sf).read("adjusted", version="latest"), "source", "ticker", "version", "ts", "close", exact=("close",))


@query("write_derived", ctes("supp_d", STORE_SERIES) + f"SELECT source || '_' || ticker AS name, frequency, {sday()}, CASE WHEN source = 'beta' THEN close * 2 ELSE close END AS close FROM st")
def write_derived(spark, sf):
    """A second write replaces the series it names and keeps the others."""
    store = new_store(spark)
    series = store_series(spark, sf).select(F.concat_ws("_", "source", "ticker").alias("name"), "frequency", "ts", "close")
    store.write_derived(series)
    store.write_derived(series.filter("name like 'beta%'").withColumn("close", F.col("close") * 2))
    return edge(store.read("derived"), "name", "frequency", "ts", "close", exact=("close",))


@query("read_derived", ctes("supp_d", STORE_SERIES) + f"SELECT source || '_' || ticker AS name, frequency, {sday()}, close FROM st WHERE source = 'beta' AND ticker = 'S4'")
def read_derived(spark, sf):
    store = new_store(spark)
    store.write_derived(store_series(spark, sf).select(F.concat_ws("_", "source", "ticker").alias("name"), "frequency", "ts", "close"))
    return edge(store.read_derived("beta_S4", "daily"), "name", "frequency", "ts", "close", exact=("close",))


@query("list_available", ctes("supp_d", STORE_SERIES, _VERSIONS) +
    "SELECT 'raw' AS layer, source, ticker, frequency, NULL::INT AS version, count(*) AS row_count FROM st GROUP BY ALL UNION ALL SELECT 'adjusted', source, ticker, frequency, version, count(*) FROM vs GROUP BY ALL UNION ALL SELECT 'derived', source || '_' || ticker, NULL, frequency, NULL, count(*) FROM st WHERE source = 'alpha' GROUP BY ALL")
def list_available(spark, sf):
    store, series = versioned_store(spark, sf), store_series(spark, sf)
    store.write_raw(series)
    store.write_derived(series.filter("source = 'alpha'").select(F.concat_ws("_", "source", "ticker").alias("name"), "frequency", "ts", "close"))
    return store.list_available()


_IDS = ("ids", "SELECT 'raw' AS layer, 'tpch_' || s_suppkey || '_daily' AS table_id FROM supplier UNION ALL SELECT 'adjusted', 'tpch_' || s_suppkey || '_daily_v' || (s_nationkey % 12) FROM supplier "
    "UNION ALL SELECT 'derived', 'tpch_' || s_suppkey || '_VOL__ab12_daily' FROM supplier UNION ALL SELECT 'raw', 'tpch_' || replace(s_name, '#', '_') || '_daily' FROM supplier UNION ALL SELECT 'adjusted', 'tpch_' || s_suppkey || '_daily' FROM supplier")


def table_ids(spark, sf):
    s = S.table(spark, sf, "supplier")
    key, out = F.col("s_suppkey").cast("string"), None
    for layer, text in (
        ("raw", F.concat(F.lit("tpch_"), key, F.lit("_daily"))),
        ("adjusted", F.concat(F.lit("tpch_"), key, F.lit("_daily_v"), (F.col("s_nationkey") % 12).cast("string"))),
        ("derived", F.concat(F.lit("tpch_"), key, F.lit("_VOL__ab12_daily"))),
        ("raw", F.concat(F.lit("tpch_"), F.replace("s_name", F.lit("#"), F.lit("_")), F.lit("_daily"))),
        ("adjusted", F.concat(F.lit("tpch_"), key, F.lit("_daily"))),
    ):
        part = s.select(F.lit(layer).alias("layer"), text.alias("table_id"))
        out = part if out is None else out.unionByName(part)
    return out


_PARSED = ("pa", "SELECT layer, table_id, CASE layer WHEN 'derived' THEN regexp_extract(table_id, '^(.*)_[^_]*$', 1) ELSE split_part(table_id, '_', 1) END AS source, CASE WHEN layer <> 'derived' THEN split_part(table_id, '_', 2) END AS ticker, 'daily' AS frequency, "
    "CASE WHEN layer = 'adjusted' THEN TRY_CAST(regexp_extract(table_id, '_v([0-9]+)$', 1) AS INT) END AS version FROM ids WHERE (layer = 'raw' AND len(string_split(table_id, '_')) = 3) OR layer = 'derived' OR (layer = 'adjusted' AND regexp_matches(table_id, '_v[0-9]+$'))")


@query("parse_series_key", ctes(_IDS, _PARSED) + "SELECT * FROM pa")
def parse_series_key(spark, sf):
    return Y.parse_series_key(table_ids(spark, sf)).select("layer", "table_id", "source", "ticker", "frequency", "version")


@query("storage_lineage", ctes(_IDS, _PARSED) +
    "SELECT source, ticker, frequency, max(table_id) FILTER (layer = 'raw') AS raw, array_to_string(list_sort(list_distinct(list(version) FILTER (version IS NOT NULL))), ',') AS adjusted_versions, "
    "(SELECT string_agg(d.table_id, ',' ORDER BY d.table_id) FROM pa d WHERE d.layer = 'derived' AND starts_with(d.table_id, p.source || '_' || p.ticker || '_')) AS derived FROM pa p WHERE layer <> 'derived' GROUP BY source, ticker, frequency")
def storage_lineage(spark, sf):
    out = Y.storage_lineage(Y.parse_series_key(table_ids(spark, sf)))
    return out.select("source", "ticker", "frequency", "raw", F.array_join(F.transform("adjusted_versions", lambda v: v.cast("string")), ",").alias("adjusted_versions"), F.array_join("derived", ",").alias("derived"))


# --- coverage and ingestion -------------------------------------------------------------------

_RANGES = ("rg", "SELECT source, ticker, frequency, min(ts) AS lo, max(ts) AS hi FROM st GROUP BY ALL")
_BUSDAYS = "(SELECT CAST(unnest(generate_series({a}::DATE, {b}::DATE, INTERVAL 1 DAY)) AS DATE) AS d)"
_BOUNDS = [("rq", "SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN 'alpha' ELSE 'beta' END AS source, 'daily' AS frequency, DATE '1995-01-07' + CAST(s_nationkey AS INT) AS a, DATE '2001-11-25' - CAST(s_suppkey % 11 AS INT) * 2 AS b FROM supplier"),
    ("fb", "SELECT *, CASE WHEN isodow(a) > 5 THEN a + (8 - isodow(a))::INT ELSE a END AS fa, CASE WHEN isodow(b) > 5 THEN b - (isodow(b) - 5)::INT ELSE b END AS lb FROM rq"),
    # five business days after a business day is one week later
    ("cv", "SELECT q.ticker, q.source, q.frequency, q.a, q.b, coalesce(r.lo <= q.fa + 7 AND r.hi >= q.lb - 1, false) AS covered FROM fb q LEFT JOIN rg r ON r.ticker = q.ticker AND r.source = q.source")]


def requests(spark, sf):
    s = S.table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.when(F.col("s_suppkey") % 3 == 0, "alpha").otherwise("beta").alias("source"), F.lit("daily").alias("frequency"),
        F.date_add(F.lit("1995-01-07").cast("date"), F.col("s_nationkey")).alias("start"), F.date_sub(F.lit("2001-11-25").cast("date"), (F.col("s_suppkey") % 11 * 2).cast("int")).alias("end"))


@query("coverage_check", ctes("supp_d", STORE_SERIES, _RANGES, *_BOUNDS) + f"SELECT source, ticker, frequency, {sday('a', 'start')}, {sday('b', 'end')}, covered FROM cv".replace("AS end,", 'AS "end",'))
def coverage_check(spark, sf):
    ranges = I.series_ranges(store_series(spark, sf))
    return edge(I.coverage_check(ranges, requests(spark, sf)), "source", "ticker", "frequency", "start", "end", "covered")


_OLD_NEW = [("od", "SELECT * FROM st WHERE ts BETWEEN DATE '1996-01-15' AND DATE '2000-06-15'"), ("nw", "SELECT * FROM st WHERE ts BETWEEN DATE '1996-01-14' AND DATE '2000-06-14' + CAST(length(ticker) AS INT)")]


@query("superset_guard", ctes("supp_d", STORE_SERIES, *_OLD_NEW, ("o", "SELECT ticker, min(ts) AS a, max(ts) AS b FROM od GROUP BY 1"), ("n", "SELECT source, ticker, min(ts) AS a, max(ts) AS b FROM nw GROUP BY 1, 2")) +
    f"SELECT source, n.ticker, {sday('o.a', 'old_start')}, {sday('n.b', 'new_end')}, n.a <= o.a AND n.b >= o.b AS accepted FROM n JOIN o ON o.ticker = n.ticker")
def superset_guard(spark, sf):
    st = store_series(spark, sf)
    old = st.filter("ts between date '1996-01-15' and date '2000-06-15'")
    new = st.filter("ts between date '1996-01-14' and date_add(date '2000-06-14', length(ticker))")
    return edge(I.superset_guard(old, new), "source", "ticker", "old_start", "new_end", "accepted")


_INGEST = ctes("supp_d", STORE_SERIES, ("full_", "SELECT * FROM st"),
    ("have", "SELECT * FROM st WHERE source = 'alpha'"), ("h", "SELECT ticker, min(ts) AS lo, max(ts) AS hi FROM have GROUP BY 1"),
    *_BOUNDS[:2], ("c0", "SELECT q.*, coalesce(h.lo <= q.fa + 7 AND h.hi >= q.lb - 1, false) AS covered FROM fb q LEFT JOIN h ON h.ticker = q.ticker"),
    ("lan", "SELECT source, ticker, frequency, ts, CASE WHEN close > 600 THEN close END AS close FROM st"),
    ("fe", "SELECT l.*, c.covered FROM lan l JOIN c0 c ON c.ticker = l.ticker AND c.source = l.source AND l.ts BETWEEN c.a AND c.b WHERE NOT c.covered"),
    ("gu", "SELECT f.ticker, coalesce(min(f.ts) <= min(h.lo) AND max(f.ts) >= max(h.hi), true) AS acc FROM fe f LEFT JOIN h ON h.ticker = f.ticker GROUP BY 1"),
    ("fl", "SELECT ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM fe"),
    ("ba", "SELECT DISTINCT ticker FROM fl WHERE c IS NULL"),
    ("sta", "SELECT c.source, c.ticker, c.frequency, CASE WHEN c.covered THEN 'covered' WHEN g.acc IS NULL THEN 'no_data' WHEN NOT g.acc THEN 'rejected' WHEN b.ticker IS NOT NULL THEN 'raw_only' ELSE 'stored' END AS status FROM c0 c LEFT JOIN gu g ON g.ticker = c.ticker LEFT JOIN ba b ON b.ticker = c.ticker"))


@query("incremental_ingest", _INGEST + "SELECT * FROM sta")
def incremental_ingest(spark, sf):
    """Half the sources are stored already; the rest comes from landed rows with missing closes."""
    store, series = new_store(spark), store_series(spark, sf)
    store.write_raw(series.filter("source = 'alpha'"))
    landing = series.withColumn("close", F.when(F.col("close") > 600, F.col("close")))
    return I.incremental_ingest(store, landing, requests(spark, sf)).select("source", "ticker", "frequency", "status")


# --- catalogue --------------------------------------------------------------------------------

VARIABLES = ("va", "SELECT s_name AS name, 'raw' AS layer FROM supplier UNION ALL SELECT n_name, 'transformed' FROM nation UNION ALL SELECT r_name, 'derived' FROM region UNION ALL SELECT 'WORLD', 'derived'")
# a nation is computed from its suppliers, a region from its nations, the world from its regions
EDGES = ("ed", "SELECT n_name AS src, s_name AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'WORLD', r_name FROM region")


def variables(spark, sf):
    s, n, r = (S.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    parts = [s.select(F.col("s_name").alias("name"), F.lit("raw").alias("layer")), n.select(F.col("n_name").alias("name"), F.lit("transformed").alias("layer")),
        r.select(F.col("r_name").alias("name"), F.lit("derived").alias("layer")), spark.createDataFrame([("WORLD", "derived")], "name string, layer string")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def edges(spark, sf):
    s, n, r = (S.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    a = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("src"), F.col("s_name").alias("dst"))
    b = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return a.unionByName(b).unionByName(r.select(F.lit("WORLD").alias("src"), F.col("r_name").alias("dst")))


@query("universe_expand", "SELECT p_brand AS universe, p_name || '_' || p_partkey AS ticker, CASE WHEN p_brand = 'Brand#1' THEN 'X_' || p_name || '_' || p_partkey ELSE p_name || '_' || p_partkey || '_CLOSE' END AS name, 'daily' AS frequency FROM part")
def universe_expand(spark, sf):
    p = S.table(spark, sf, "part")
    template = p.select(F.col("p_brand").alias("universe")).distinct().select(
        "universe", F.when(F.col("universe") == "Brand#1", "X_{ticker}").otherwise("{ticker}_CLOSE").alias("pattern"), F.lit("daily").alias("frequency"))
    tickers = p.select(F.col("p_brand").alias("universe"), F.concat_ws("_", "p_name", "p_partkey").alias("ticker"))
    return R.universe_expand(template, tickers).select("universe", "ticker", "name", "frequency")


@query("registry_lookup", ctes(VARIABLES, ("w", "SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT s_name FROM supplier WHERE s_acctbal > 5000")) + "SELECT w.name, va.layer, va.name IS NOT NULL AS known FROM w LEFT JOIN va ON va.name = w.name")
def registry_lookup(spark, sf):
    wanted = S.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(S.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_name").alias("name")))
    return R.registry_lookup(variables(spark, sf), wanted).select("name", "layer", "known")


@query("filter_layer", ctes(VARIABLES) + "SELECT name FROM va WHERE layer = 'raw'")
def filter_layer(spark, sf):
    return R.filter_layer(variables(spark, sf), "raw").select("name")


_REFS = "SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem"


@query("unresolved_refs", f"SELECT DISTINCT src, dst FROM ({_REFS}) WHERE dst NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def unresolved_refs(spark, sf):
    refs = S.table(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    known = S.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return R.unresolved_refs(refs, known)


@query("duplicate_names", "SELECT p_name AS name, count(*) AS definitions FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return R.duplicate_names(S.table(spark, sf, "part").select(F.col("p_name").alias("name")))


@query("dependency_edges", "SELECT 'O' || l_orderkey AS src, 'S' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'O' || l_orderkey, 'F' || l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def dependency_edges(spark, sf):
    def tag(letter, c):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    specs = S.table(spark, sf, "lineitem").select(
        tag("O", "l_orderkey").alias("name"), F.when(F.col("l_returnflag") != "R", tag("S", "l_suppkey")).alias("source_variable"),
        F.when(F.col("l_returnflag") == "R", F.array(tag("S", "l_suppkey"), tag("P", "l_partkey"))).alias("sources"),
        F.when(F.col("l_returnflag") == "R", F.array(tag("F", "l_returnflag"))).alias("inputs"))
    return R.dependency_edges(specs)


# suppliers depend on each other where their lines follow in one order
_CYC = [("ce", "SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"),
    ("cl", "SELECT src, dst FROM ce UNION SELECT cl.src, ce.dst FROM cl JOIN ce ON ce.src = cl.dst")]


def cycle_edges(spark, sf):
    li = S.table(spark, sf, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_suppkey").alias("src"))
    return a.join(li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dst")), ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


@query("dependency_cycles", "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in _CYC) + " SELECT DISTINCT src AS name FROM cl WHERE src = dst")
def dependency_cycles(spark, sf):
    return R.dependency_cycles(cycle_edges(spark, sf))


@query("used_by", ctes(EDGES) + 'SELECT DISTINCT dst AS name, src AS "user" FROM ed')
def used_by(spark, sf):
    return R.used_by(edges(spark, sf))


@query("used_by_transitive", f"WITH RECURSIVE ed AS ({EDGES[1]}), cl AS (SELECT src, dst FROM ed UNION SELECT cl.src, ed.dst FROM cl JOIN ed ON ed.src = cl.dst) SELECT dst AS name, src AS user FROM cl".replace("AS user", 'AS "user"'))
def used_by_transitive(spark, sf):
    return R.used_by_transitive(edges(spark, sf))


@query("variable_lineage", f"WITH RECURSIVE ed AS ({EDGES[1]}), va AS ({VARIABLES[1]}), tr AS (SELECT name AS root, 0 AS depth, name AS path, name FROM va UNION ALL SELECT tr.root, tr.depth + 1, tr.path || '>' || ed.dst, ed.dst FROM tr JOIN ed ON ed.src = tr.name) SELECT tr.root, tr.depth, tr.path, tr.name, va.layer FROM tr JOIN va ON va.name = tr.name")
def variable_lineage(spark, sf):
    return R.variable_lineage(edges(spark, sf), variables(spark, sf)).select("root", "depth", F.array_join("path", ">").alias("path"), "name", "layer")


_SPEC = ("sp", "SELECT 'V' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'rolling_vol' ELSE 'log_return' END AS transformation, 'C' || p_partkey AS source_variable, p_size AS win, CASE WHEN p_size % 2 = 0 THEN true END AS annualised FROM part")
_HASH = """substr(sha256('{' || CASE WHEN annualised IS NOT NULL THEN '"annualised": ' || annualised || ', ' ELSE '' END || '"frequency": "daily", "source_frequency": "daily", "source_variable": "' || source_variable || '", "transformation": "' || transformation || '", "window": ' || win || '}'), 1, 8)"""


def specs(spark, sf, shift=0):
    even = F.col("p_size") % 2 == 0
    return S.table(spark, sf, "part").select(
        F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("name"), F.when(even, "rolling_vol").otherwise("log_return").alias("transformation"),
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("source_variable"), (F.col("p_size") + shift).alias("window"),
        F.when(even, F.lit(True)).alias("annualised"), F.lit("daily").alias("frequency"), F.lit("daily").alias("source_frequency"))


@query("spec_hash", ctes(_SPEC) + f"SELECT name, {_HASH} AS spec_hash, name || '__' || {_HASH} || '_daily' AS derived_id FROM sp")
def spec_hash(spark, sf):
    return R.spec_hash(specs(spark, sf)).select("name", "spec_hash", "derived_id")


@query("stale_derived", ctes(_SPEC, ("o", f"SELECT name, {_HASH} AS spec_hash FROM sp"), ("n", f"SELECT name, {_HASH} AS spec_hash FROM (SELECT * REPLACE (win + 10 AS win) FROM sp) sp")) +
    "SELECT name, spec_hash FROM (SELECT * FROM o UNION ALL SELECT * FROM n)")
def stale_derived(spark, sf):
    """After every window changed twice, the two earlier generations are stale."""
    old, mid, new = (R.spec_hash(specs(spark, sf, k)).select("name", "spec_hash") for k in (0, 10, 20))
    return R.stale_derived(old.unionByName(mid).unionByName(new), new)


@query("derived_cache", ctes("nation_d", ("r", "SELECT ts, asset, ln(value) - ln(lag(value) OVER (PARTITION BY asset ORDER BY ts)) AS v FROM nation_d"),
    ("k", "SELECT 1 AS request, false AS hit, r.* FROM r WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' UNION ALL SELECT 2, true, r.* FROM r WHERE ts BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' UNION ALL SELECT 3, false, r.* FROM r WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")) +
    f"SELECT request, hit, asset, {sday()}, {rnd_sql('v')} AS close FROM k")
def derived_cache(spark, sf):
    """Computed, then reused for a narrower range, then recomputed for a wider one."""
    store, out = new_store(spark), None

    def compute():
        return T.log_return(S.nation_d(spark, sf)).withColumnRenamed("value", "close")

    for i, (a, b) in enumerate([("1997-01-01", "1998-12-31"), ("1998-01-01", "1998-06-30"), ("1996-01-01", "1998-12-31")], 1):
        rows, hit = R.derived_cache(store, "NATION_RET__ab12cd34", "daily", a, b, compute)
        path = shared_dir(spark, "request")
        rows.select(F.lit(i).alias("request"), F.lit(hit).alias("hit"), "asset", "ts", "close").write.parquet(path)
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    return edge(out)


@query("transformation_log", ctes(_SPEC) + f"SELECT name AS variable_name, {_HASH} AS spec_hash, 'daily' AS frequency, 2 AS entries FROM sp")
def transformation_log(spark, sf):
    """Two runs appended to the log, counted per variable."""
    path = shared_dir(spark, "transformation_log")
    entries = R.spec_hash(specs(spark, sf)).select(F.col("name").alias("variable_name"), "spec_hash", "frequency", F.current_timestamp().alias("created_at"), F.lit("variables.yaml").alias("source_path"))
    R.log_transformations(entries, path)
    R.log_transformations(entries, path)
    return spark.read.parquet(path).groupBy("variable_name", "spec_hash", "frequency").agg(F.count(F.lit(1)).cast("int").alias("entries"))


@query("result_sink", ctes("supp_m", ("dy", "SELECT asset AS run, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) / 10 - 0.1 AS net FROM supp_m"), ("m", "SELECT run, round(CASE WHEN count(net) >= 2 AND stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) END, 6) + 0.0 AS sharpe FROM dy GROUP BY 1")) +
    "SELECT fmt, run, sharpe, 2 AS index_rows FROM m, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt)")
def result_sink(spark, sf):
    """Metrics written as csv, json and parquet and read back, with a run index of two appends."""
    from .portfolio_queries import supplier_returns
    metrics = edge(B.avg_sharpe_clean(supplier_returns(spark, sf), ["run"], "net"))
    root, out = shared_dir(spark, "results"), None
    run = spark.range(1).select(F.current_timestamp().alias("timestamp"), F.lit("run").alias("run_id"), F.lit(root).alias("path"), F.lit("").alias("git_commit"), F.lit(False).alias("git_dirty"))
    for _ in range(2):
        Y.append_run_index(run, f"{root}/index")
    n = spark.read.parquet(f"{root}/index").agg(F.count(F.lit(1)).cast("int")).scalar()
    for fmt in ("csv", "json", "parquet"):
        Y.write_results(metrics, f"{root}/{fmt}", fmt)
        part = L.scan_series(spark, f"{root}/{fmt}", fmt, "run long, sharpe double").select(F.lit(fmt).alias("fmt"), "run", "sharpe")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("index_rows", n)


# --- reading by name --------------------------------------------------------------------------


def catalogue_specs(spark, sf):
    """Per supplier a stored close, its returns over one and two days, their difference, and a volatility."""
    key = F.col("s_suppkey").cast("string")
    none = F.lit(None)

    def specs(suffix, layer, transformation=none, source=none, sources=none, window=none, annualised=none):
        return S.table(spark, sf, "supplier").select(
            F.concat(F.lit("S"), key, F.lit(suffix)).alias("name"), F.lit(layer).alias("layer"),
            (F.when(F.col("s_suppkey") % 3 == 0, "ALPHA").otherwise("Beta") if layer == "raw" else none).cast("string").alias("source"),
            none.cast("string").alias("series_id"), (F.concat(F.lit("S"), key) if layer == "raw" else none).cast("string").alias("ticker"),
            F.lit("daily").alias("frequency"), F.lit("daily").alias("source_frequency"), transformation.cast("string").alias("transformation"),
            source.cast("string").alias("source_variable"), sources.cast("array<string>").alias("sources"), window.cast("int").alias("window"), annualised.cast("boolean").alias("annualised"))

    of = lambda suffix: F.concat(F.lit("S"), key, F.lit(suffix))
    parts = [specs("_CLOSE", "raw"), specs("_RET", "transformed", F.lit("log_return"), of("_CLOSE"), window=F.lit(1)), specs("_RET2", "transformed", F.lit("log_return"), of("_CLOSE"), window=F.lit(2)),
        specs("_GAP", "transformed", F.lit("difference"), sources=F.array(of("_RET"), of("_RET2"))), specs("_VOL", "transformed", F.lit("rolling_vol"), of("_GAP"), window=F.col("s_suppkey") % 3 + 4, annualised=F.lit(True))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CHAIN = [("c", "SELECT *, CAST(ticker[2:] AS BIGINT) AS k FROM st WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"),
    ("r", "SELECT k, ts, ln(close / lag(close) OVER w) AS r1, ln(close / lag(close, 2) OVER w) AS r2 FROM c WINDOW w AS (PARTITION BY k ORDER BY ts)"),
    ("g", "SELECT k, ts, r1, r1 - r2 AS d FROM r"),
    ("v", "SELECT k, ts, r1, d, CASE k % 3 " + " ".join(f"WHEN {i} THEN CASE WHEN count(d) OVER w{i} = {i + 4} THEN stddev_samp(d) OVER w{i} END" for i in range(3)) + " END * sqrt(252) AS vol FROM g WINDOW " + ", ".join(f"w{i} AS (PARTITION BY k ORDER BY ts ROWS BETWEEN {i + 3} PRECEDING AND CURRENT ROW)" for i in range(3))),
    ("u", "SELECT 'S' || k || '_GAP' AS asset, ts, d AS x FROM v UNION ALL SELECT 'S' || k || '_VOL', ts, vol FROM v UNION ALL SELECT 'S' || k || '_CLOSE', ts, close FROM c"),
    ("p", "SELECT asset, CAST(date_trunc('month', ts) AS DATE) AS q, max_by(x, ts) AS x FROM u WHERE x IS NOT NULL GROUP BY 1, 2"),
    ("s", "SELECT asset, min(q) AS lo FROM p GROUP BY 1"), ("m", "SELECT asset, CAST(unnest(generate_series(lo, DATE '1998-12-31', INTERVAL 1 MONTH)) AS DATE) AS q FROM s")]


@query("catalogue_read", ctes("supp_d", STORE_SERIES, *_CHAIN) + f"SELECT m.asset, {sday('last_day(m.q)', 'ts')}, {rnd_sql('p.x')} AS value FROM m LEFT JOIN p USING (asset, q)")
def catalogue_read(spark, sf):
    """Monthly values of stored closes, of differences of their returns, and of volatilities of these: a chain of
    three transformations, computed in a first read and found in the derived layer by the second."""
    store = new_store(spark)
    names = C.Catalogue(spark, store, catalogue_specs(spark, sf), store_series(spark, sf))
    wanted = names.specs.filter("name LIKE '%GAP' OR name LIKE '%VOL' OR name LIKE '%CLOSE'")
    names.get(wanted, "1996-01-01", "1998-12-31")
    return edge(names.get(wanted, "1996-01-01", "1998-12-31", "monthly"), "asset", "ts", "value")


@query("fetch_or_load", ctes("supp_d", STORE_SERIES, *_BOUNDS[:1]) + f"SELECT DISTINCT st.source, st.ticker, {sday('st.ts', 'ts')}, st.close FROM st JOIN rq ON st.ticker = rq.ticker AND st.source = rq.source AND st.ts BETWEEN rq.a AND rq.b")
def fetch_or_load(spark, sf):
    """Rows of every supplier's request: one source is stored, the other only landed."""
    store, series = new_store(spark), store_series(spark, sf)
    store.write_raw(series.filter("source = 'alpha'"))
    return edge(I.fetch_or_load(store, series, requests(spark, sf)), "source", "ticker", "ts", "close", exact=("close",))
