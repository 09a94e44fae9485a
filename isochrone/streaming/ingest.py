"""Raw rows from a stream, each stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import BatchTable, run_available


def first_arrivals(rows: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Rows whose key has not come within ``delay`` of event time before; one row per key on a table.

    Keys are remembered until the watermark has passed their ``ts`` by ``delay``; a row sent again later than that
    is older than the watermark and dropped with it. Rows without ``ts`` or a key column cannot be told apart and
    are left out.
    """
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in dict.fromkeys([*keys, ts]))).withWatermark(ts, delay)
    return known.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else known.dropDuplicates(keys)


class RawStream:
    """A raw table fed by a stream: repeated rows and repeated micro-batches leave one copy."""

    def __init__(self, spark: SparkSession, rows: DataFrame, root: str, keys: list[str], delay: str, ts: str = "ts"):
        self.rows, self.checkpoint = first_arrivals(rows, keys, delay, ts), f"{root.rstrip('/')}/checkpoint"
        self.table = BatchTable(spark, f"{root.rstrip('/')}/raw", rows.schema)

    def run(self, after: Callable[[int], None] | None = None) -> list[dict]:
        """Store what has arrived; ``after(batch)`` is called when a batch is written, before it is committed."""

        def write(rows: DataFrame, batch: int) -> None:
            self.table.write(rows, batch)
            if after is not None:
                after(batch)

        return run_available(self.rows, self.checkpoint, write)

    def read(self) -> DataFrame:
        return self.table.read()

    def ranges(self, series: list[str], ts: str = "ts") -> DataFrame:
        """First and last row and number of rows of every series, as the coverage checks take them."""
        return self.read().groupBy(*series).agg(F.min(ts).alias("cached_start"), F.max(ts).alias("cached_end"), F.count("*").alias("row_count"))
