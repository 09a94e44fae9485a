"""Helpers shared by the text operators: row reading, words, intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spark import delete_shared, write_shared

#: White space in the word rules: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Spark's setting under which a query's shuffle files are deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, into: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that no lost executor brings back the
    work before it. ``into`` notes the folder for ``discard``. The shuffle files of the step go with its end:
    nothing reads them again, and else they stay until the driver happens to collect its garbage."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        path = write_shared(df, name)
    finally:
        conf.set(CLEAN_UP, before) if before is not None else conf.unset(CLEAN_UP)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete stored tables. Only for tables that nothing will read again, a lost executor's work
    included: whatever was computed from them is stored itself."""
    while folders:
        delete_shared(spark, folders.pop())


def text_of(column: str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order; an empty array for a text without any."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))


def count_words(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def carried(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that none can clash with a column of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, with the names, when columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
