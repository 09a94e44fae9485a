"""Streams over driver-table rows that land in several parts, each checked against the same rows as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spark import shared_dir
from ..streaming.alerts import AlertStream
from ..streaming.bars import BarStream
from ..streaming.ingest import RawStream
from ..streaming.tables import landed
from . import panels as S
from .panels import ctes, edge, sts
from .registry import query

WEEKS = [f"2024-01-{d:02d}" for d in (1, 9, 17, 25)] + ["2024-02-29"]


def events(spark, sf) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), "value")


def fed(rows: DataFrame, parts: list[str], make, repeat_days: int = 0):
    """The stream ``make`` builds over a landing folder, run after each arrival: one per span of ``parts``, which
    brings the last days of the one before again."""
    path, stream = shared_dir(rows.sparkSession, "landing"), None
    for a, b in zip(parts, parts[1:], strict=False):
        first = F.date_sub(F.lit(a).cast("date"), repeat_days).cast("timestamp")
        rows.where((F.col("ts") >= first) & (F.col("ts") < F.lit(b).cast("timestamp"))).write.mode("append").parquet(path)
        stream = stream or make(landed(rows.sparkSession, path, rows.schema))
        stream.run()
    return stream


@query("stream_bars", f"SELECT event_type AS asset, {sts('t', 'bar_start')}, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n "
    "FROM (SELECT *, date_trunc('hour', ts) AS t FROM events WHERE value IS NOT NULL) e GROUP BY event_type, t")
def stream_bars(spark, sf):
    """Hourly bars of four weekly arrivals, a run each; rows of an arrival may come in any order."""
    stream = fed(events(spark, sf), WEEKS, lambda rows: BarStream(spark, rows, shared_dir(spark, "bars"), "1 hour", "2 hours", ["asset"], tie="event_id"))
    return edge(stream.read(), exact=("open", "high", "low", "close"))


@query("stream_raw_ingest", f"SELECT event_id, event_type AS asset, {sts()}, value FROM events")
def stream_raw_ingest(spark, sf):
    """Every arrival brings two days of the one before again; rows are stored once."""
    stream = fed(events(spark, sf), WEEKS, lambda rows: RawStream(spark, rows, shared_dir(spark, "raw"), ["event_id"], "3 days"), repeat_days=2)
    return edge(stream.read(), exact=("value",))


YEARS = ["1990-01-01", "1994-01-01", "1996-01-01", "1998-01-01", "2000-01-01", "2010-01-01"]
# the move of a month in the direction of the month before: a momentum signal's result for one asset
_MOVES = ("mv", "SELECT asset, ts, value / lag(value) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM supp_m")
_MEASURE = ("ms", "SELECT asset, ts, round(sign(lag(r) OVER (PARTITION BY asset ORDER BY ts)) * r, 9) AS ic FROM mv")


@query("stream_ic_alert", ctes("supp_m", _MOVES, _MEASURE,
    ("b", "SELECT *, ic < -0.05 AS bad, ts - lag(ts) OVER (PARTITION BY asset ORDER BY ts) > 100 AS gap FROM ms WHERE ic IS NOT NULL"),
    ("i", "SELECT *, sum(CASE WHEN NOT bad OR coalesce(gap, false) THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts) AS island FROM b"),
    ("n", "SELECT asset, ts, row_number() OVER w AS nth, first_value(ts) OVER w AS a FROM i WHERE bad WINDOW w AS (PARTITION BY asset, island ORDER BY ts)")) +
    f"SELECT asset, {sts('CAST(a AS TIMESTAMP)', 'started')}, {sts('CAST(ts AS TIMESTAMP)', 'raised')} FROM n WHERE nth = 3")
def stream_ic_alert(spark, sf):
    """Months of every supplier's signal result in five arrivals; one alert per three bad months in a row."""
    w = Window.partitionBy("asset").orderBy("ts")
    moves = S.supp_m(spark, sf).select("asset", "ts", (F.col("value") / F.lag("value").over(w) - 1).alias("r"))
    measured = moves.select("asset", F.col("ts").cast("timestamp").alias("ts"), F.round(F.signum(F.lag("r").over(w)) * F.col("r"), 9).alias("ic"))
    stream = fed(measured, YEARS, lambda rows: AlertStream(spark, rows, shared_dir(spark, "alerts"), key="asset"))
    return edge(stream.read())
