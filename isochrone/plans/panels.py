"""Panels over the driver tables: raw rows are aggregated to one row per (asset, period) first, so
a hot asset is combined map-side before anything is shuffled. Each has the same panel as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.spark import read_shared, write_shared
from ..operators.panel import dense_panel
from ..operators.series import with_positions, with_windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ROWS: dict[tuple[str, str, str], int] = {}


def universe(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a dimension table (answered from file metadata): a proven bound on a cross-section."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _ROWS:
        _ROWS[key] = table(spark, sf_dir, name).count()
    return _ROWS[key]


_STORED: dict[tuple[str, str, str], tuple] = {}


def _stored(build):
    """Keep a panel as a written table for the rest of the session.

    Everything after the panel is small next to the raw rows and reads it several times (dates,
    assets, values), so the raw table is scanned once. The table lies in the shared folder, so
    losing an executor does not bring the scan back; it is built again when the folder was cleared.
    ``forget_panels`` starts over, e.g. after the raw tables changed.
    """

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), build.__name__)
        kept = read_shared(spark, *_STORED[key]) if key in _STORED else None
        if kept is not None:
            return kept
        panel = build(spark, sf_dir)
        _STORED[key] = (write_shared(panel, build.__name__), panel.schema)
        return read_shared(spark, *_STORED[key])

    get.__doc__ = build.__doc__
    get.build = build
    return get


def forget_panels() -> None:
    _STORED.clear()
    _ROWS.clear()


def _hundredths(c: str):
    """A two-decimal column as whole hundredths: integer sums do not depend on the order in which
    partial results arrive, so a recomputed task gives the same panel bit for bit."""
    return F.round(F.col(c) * 100).cast("long")


def _unit_price():
    return F.sum(_hundredths("l_extendedprice")) / (F.lit(100.0) * F.sum("l_quantity"))


def _average(c: str):
    return F.sum(_hundredths(c)) / (F.lit(100.0) * F.count(c))


def _day(c: str):
    return F.to_date(c)


def _month(c: str):
    return F.trunc(c, "month")


@_stored
def supp_m(spark, sf_dir) -> DataFrame:
    """Monthly unit price per supplier; the number of assets grows with the data."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("asset"), _month("l_shipdate").alias("ts")).agg(_unit_price().alias("value"))


@_stored
def supp_x(spark, sf_dir) -> DataFrame:
    """``supp_m`` with every supplier on every month, plus ``prev``, the value of its previous row."""
    own = with_windows(supp_m(spark, sf_dir), ["asset"], lambda w: {"prev": F.lag("value", 1).over(w)}, before=1)
    return dense_panel(own)


@_stored
def supp_d(spark, sf_dir) -> DataFrame:
    """Daily unit price per supplier (rows only where something shipped)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("asset"), _day("l_shipdate").alias("ts")).agg(_unit_price().alias("value"))


@_stored
def rate_m(spark, sf_dir) -> DataFrame:
    """Monthly average discount per supplier, used as an interest rate."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("asset"), _month("l_shipdate").alias("ts")).agg(_average("l_discount").alias("value"))


@_stored
def brand_m(spark, sf_dir) -> DataFrame:
    """Monthly unit price per brand."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    return li.join(part, "l_partkey").groupBy("asset", _month("l_shipdate").alias("ts")).agg(_unit_price().alias("value"))


def _nation_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("asset"))
    return orders.join(customer, "c_custkey").join(nation, "n_nationkey")


@_stored
def nation_m(spark, sf_dir) -> DataFrame:
    return _nation_orders(spark, sf_dir).groupBy("asset", _month("o_orderdate").alias("ts")).agg(_average("o_totalprice").alias("value"))


@_stored
def nation_d(spark, sf_dir) -> DataFrame:
    return _nation_orders(spark, sf_dir).groupBy("asset", _day("o_orderdate").alias("ts")).agg(_average("o_totalprice").alias("value"))


def nation_classes(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("asset"), F.col("r_name").alias("cls"))


@_stored
def prio_d(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("asset"), _day("o_orderdate").alias("ts")).agg(_average("o_totalprice").alias("value"))


@_stored
def event_h(spark, sf_dir) -> DataFrame:
    """Hourly average value per event type; ``ts`` is a timestamp, ``pos`` the row index, so that
    chained windows do not count positions again."""
    ev = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    hourly = ev.groupBy(F.col("event_type").alias("asset"), hour.alias("ts")).agg(_average("value").alias("value"))
    return with_positions(hourly, ["asset"])


def vintages(spark, sf_dir) -> DataFrame:
    """Events as revisions: key, observation date, time it became known, value."""
    ev = table(spark, sf_dir, "events").filter("value is not null")
    return ev.select(
        F.concat_ws(":", "user_id", "event_type").alias("ticker"), F.to_date("ts").alias("obs_date"),
        F.col("ts").cast("timestamp").alias("realtime_start"), "event_id", "value",
    )


_LI_PRICE = "sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (100.0 * sum(l_quantity))"


def _avg_sql(c: str) -> str:
    return f"sum(CAST(round({c} * 100) AS BIGINT)) / CAST(100 * count({c}) AS DOUBLE)"


_NATION_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

# Each panel as a common table expression; dense ones end in _x.
PANEL_SQL = {
    "supp_m": f"SELECT l_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, {_LI_PRICE} AS value FROM lineitem GROUP BY 1, 2",
    "supp_d": f"SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS ts, {_LI_PRICE} AS value FROM lineitem GROUP BY 1, 2",
    "rate_m": f"SELECT l_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, {_avg_sql('l_discount')} AS value FROM lineitem GROUP BY 1, 2",
    "brand_m": f"SELECT p_brand AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, {_LI_PRICE} AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "nation_m": f"SELECT n_name AS asset, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, {_avg_sql('o_totalprice')} AS value FROM {_NATION_FROM} GROUP BY 1, 2",
    "nation_d": f"SELECT n_name AS asset, CAST(o_orderdate AS DATE) AS ts, {_avg_sql('o_totalprice')} AS value FROM {_NATION_FROM} GROUP BY 1, 2",
    "nation_classes": "SELECT n_name AS asset, r_name AS cls FROM nation JOIN region ON n_regionkey = r_regionkey",
    "prio_d": f"SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS ts, {_avg_sql('o_totalprice')} AS value FROM orders GROUP BY 1, 2",
    "event_h": f"SELECT event_type AS asset, date_trunc('hour', ts) AS ts, {_avg_sql('value')} AS value FROM events GROUP BY 1, 2",
    "vintages": "SELECT concat_ws(':', user_id, event_type) AS ticker, CAST(ts AS DATE) AS obs_date, ts AS realtime_start, event_id, value FROM events WHERE value IS NOT NULL",
}


def dense_sql(src: str, keys: str = "asset") -> str:
    return (
        f"SELECT c.ts, a.{keys}, p.value FROM (SELECT DISTINCT ts FROM {src}) c "
        f"CROSS JOIN (SELECT DISTINCT {keys} FROM {src}) a LEFT JOIN {src} p ON p.ts = c.ts AND p.{keys} = a.{keys}"
    )


def ctes(*steps) -> str:
    """``WITH`` clause: a panel name, the dense form ``name_x`` of one, or an ``(alias, sql)`` step."""
    done: dict[str, str] = {}
    for step in steps:
        if isinstance(step, tuple):
            done[step[0]] = step[1]
        elif step.endswith("_x"):
            done.setdefault(step[:-2], PANEL_SQL[step[:-2]])
            done[step] = dense_sql(step[:-2])
        else:
            done.setdefault(step, PANEL_SQL[step])
    recursive = "RECURSIVE " if any("UNION ALL" in s and f"FROM {n}" in s for n, s in done.items()) else ""
    return f"WITH {recursive}" + ",\n".join(f"{name} AS ({sql})" for name, sql in done.items()) + "\n"


def rank_sql(by: str, value: str) -> str:
    """Average rank in SQL (rows with a missing value must be excluded by the caller)."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END"


def rank_corr_sql(x: str, y: str) -> str:
    """Correlation of two average-rank columns from exact sums."""
    m = "count(*) * (count(*) + 1.0::DOUBLE) * (count(*) + 1)"
    return f"(sum(4 * {x} * {y}) - {m}) / nullif(sqrt((sum(4 * {x} * {x}) - {m}) * (sum(4 * {y} * {y}) - {m})), 0)"


def div_sql(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"


def ln_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def rnd_sql(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def fday(c: str = "ts"):
    """Dates leave queries as ISO text, timestamps with seconds."""
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def fts(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sday(c: str = "ts", alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {alias or c}"


def sts(c: str = "ts", alias: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {alias or c}"


def edge(df: DataFrame, *columns, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Final projection: dates as text, doubles rounded (except ``exact`` ones, which are read
    through unchanged or built by single operations)."""
    picked = df.select(*columns) if columns else df
    out = []
    for name, kind in picked.dtypes:
        if kind == "date":
            out.append(fday(name))
        elif kind.startswith("timestamp"):
            out.append(fts(name))
        elif kind == "double" and name in exact:
            out.append((F.col(name) + F.lit(0.0)).alias(name))
        elif kind == "double":
            out.append(r6(F.col(name), digits).alias(name))
        else:
            out.append(F.col(name))
    return picked.select(*out)


def dense(df: DataFrame) -> DataFrame:
    return dense_panel(df)
