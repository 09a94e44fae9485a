"""Alerts on a metric that stays bad for several periods in a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .tables import BatchTable, run_available

# A rank correlation below this, in so many periods in a row, is worth an alert.
BAD_IC = -0.05
BAD_PERIODS = 3
DAY = 86_400_000_000


def _prepared(metrics: DataFrame, key: str, measure: str, ts: str) -> DataFrame:
    return metrics.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(measure).isNotNull())


def alerts(metrics: DataFrame, key: str = "signal", measure: str = "ic", ts: str = "ts", threshold: float = BAD_IC, periods: int = BAD_PERIODS, expiry_days: int = 100, delay: str = "0 seconds") -> DataFrame:
    """key, started, raised: one alert at the ``periods``-th bad period in a row of a stream.

    A run of bad periods ends with a period at or above ``threshold``, or when the next one is more than
    ``expiry_days`` later; longer runs raise no second alert. State (last period, start and length of the
    run) is one small row per key, is kept across batches and dropped once the watermark has passed the expiry.
    Periods of a key must arrive in order, up to ``delay``, within a batch in any order; an earlier or repeated
    one is ignored, and so are rows without key, period or measure.
    """
    expiry = expiry_days * DAY
    kind = metrics.schema[key].dataType

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, start, length = state.get if state.exists else (None, None, 0)
        raised = []
        rows = pd.concat(list(frames)).sort_values(["at", "m"])
        for at, m in zip(rows["at"].tolist(), rows["m"].tolist(), strict=True):
            if last is not None and at <= last:
                continue
            if last is not None and at - last > expiry:
                length = 0
            start, length = (at if length == 0 else start, length + 1) if m < threshold else (None, 0)
            last = at
            if length == periods:
                raised.append((k[0], start, at))
        state.update((last, start, length))
        state.setTimeoutTimestamp(max((last + expiry) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(raised, columns=["key", "started", "raised"])

    timed = _prepared(metrics, key, measure, ts).withWatermark(ts, delay)
    rows = timed.select(ts, F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("at"), F.col(measure).cast("double").alias("m"))
    output = T.StructType([T.StructField("key", kind), T.StructField("started", T.LongType()), T.StructField("raised", T.LongType())])
    found = rows.groupBy("key").applyInPandasWithState(update, output, "last long, start long, length int", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_micros("started").alias("started"), F.timestamp_micros("raised").alias("raised"))


def alerts_of_table(metrics: DataFrame, key: str = "signal", measure: str = "ic", ts: str = "ts", threshold: float = BAD_IC, periods: int = BAD_PERIODS, expiry_days: int = 100) -> DataFrame:
    """The same alerts over a finished table: runs are islands between good periods and long gaps."""
    own = Window.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts))
    # of repeated periods the smallest measure counts, as in a batch of the stream
    rows = _prepared(metrics, key, measure, ts).groupBy(key, ts).agg(F.min(measure).alias("m"))
    rows = rows.withColumn("bad", F.col("m") < threshold).withColumn("gap", at - F.lag(at).over(own) > expiry_days * DAY)
    rows = rows.withColumn("island", F.sum(F.when(~F.col("bad") | F.coalesce("gap", F.lit(False)), 1).otherwise(0)).over(own)).where("bad")
    inside = Window.partitionBy(key, "island").orderBy(ts)
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("started", F.first(ts).over(inside))
    return rows.where(F.col("nth") == periods).select(key, "started", F.col(ts).alias("raised"))


class AlertStream:
    """Alerts raised so far; every run processes the periods that arrived since the one before."""

    def __init__(self, spark: SparkSession, metrics: DataFrame, root: str, **options):
        self.found, self.checkpoint = alerts(metrics, **options), f"{root.rstrip('/')}/checkpoint"
        self.table = BatchTable(spark, f"{root.rstrip('/')}/alerts", self.found.schema)

    def run(self) -> list[dict]:
        return run_available(self.found, self.checkpoint, self.table.write)

    def read(self) -> DataFrame:
        return self.table.read()
