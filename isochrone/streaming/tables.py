"""Landing folders as streams, and tables that a stream fills batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spark import read_shared


def landed(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """The files of a folder as a stream, in order of arrival; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


class BatchTable:
    """A table with one folder per micro-batch.

    A micro-batch that is run again after a failure has the same number and the same rows, and overwrites its
    own folder: its rows are there once, whatever was written before the failure.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        stored = read_shared(self.spark, self.path, schema)
        return self.spark.createDataFrame([], schema) if stored is None else stored

    def read(self) -> DataFrame:
        """All rows written."""
        return self._stored().drop("batch")

    def current(self, keys: list[str]) -> DataFrame:
        """The rows of the last batch that wrote each key, for streams that write a row again when it changes."""
        last = F.max_by(F.struct(*[F.col(c) for c in self.schema.fieldNames() if c not in keys]), "batch").alias("row")
        return self._stored().groupBy(*keys).agg(last).select(*keys, "row.*").select(*self.schema.fieldNames())


def run_available(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Process what has arrived since the last run, and stop; progress of each micro-batch.

    ``checkpoint`` keeps offsets and state between runs; it must be in storage that driver and executors share.
    """
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return list(query.recentProgress)


def dropped_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark had passed them."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in progress for s in p["stateOperators"])
