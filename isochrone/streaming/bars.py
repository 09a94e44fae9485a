"""Bars (open, high, low, close, count) of rows as they arrive, on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import BatchTable, run_available


def bars(rows: DataFrame, width: str, delay: str, keys: list[str], value: str = "value", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Bars of tumbling windows of ``width``: keys, bar_start, open, high, low, close, n.

    Works on a stream and on a table alike. In a stream, state of a window is kept until the watermark (the
    latest event time less ``delay``) has passed its end; rows that come later are left out. Open and close are
    the first and last row by ``ts``, then by ``tie``; rows without ``ts`` or value are ignored. Only one row of
    partial results per window, key and task is shuffled, so a hot key costs no more than others.
    """
    known = rows.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, delay)
    at = F.struct(ts, *([tie] if tie else []))
    grouped = known.groupBy(F.window(ts, width).alias("window"), *keys).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("n"))
    return grouped.select(*keys, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "n")


class BarStream:
    """Bars kept up to date: every run processes the rows that arrived since the one before."""

    def __init__(self, spark: SparkSession, rows: DataFrame, root: str, width: str, delay: str, keys: list[str], value: str = "value", ts: str = "ts", tie: str | None = None):
        self.keys, self.checkpoint = keys, f"{root.rstrip('/')}/checkpoint"
        self.made = bars(rows, width, delay, keys, value, ts, tie)
        self.table = BatchTable(spark, f"{root.rstrip('/')}/bars", T.StructType([T.StructField(f.name, f.dataType) for f in self.made.schema.fields]))

    def run(self) -> list[dict]:
        """Bars that changed are written again; unfinished ones are there at once."""
        return run_available(self.made, self.checkpoint, self.table.write, "update")

    def read(self) -> DataFrame:
        return self.table.current([*self.keys, "bar_start"])
