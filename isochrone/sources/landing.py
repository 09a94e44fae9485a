"""Landed vendor series: scanning, the close contract, vintages and key hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spark import require_none

# Layout of a landed series file and the characters a store key may not hold.
LANDED_SCHEMA = "timestamp timestamp, close double, fill_type string, is_outlier boolean, clean_version int"
KEY_REPLACED = "=-.^/"


def scan_series(
    spark: SparkSession, path: str, fmt: str = "csv", schema: str = LANDED_SCHEMA, where: Column | None = None, ordered: bool = False
) -> DataFrame:
    """Read landed series with an explicit schema. ``where`` on partition columns prunes folders,
    on the rest it is pushed into the scan."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    df = df if where is None else df.filter(where)
    return df.orderBy("timestamp") if ordered else df


def normalise_contract(raw: DataFrame, source: str, ts: str = "ts", keep: tuple[str, ...] = ()) -> DataFrame:
    """Vendor frame to ``(keep..., timestamp, close, source)``: the close column is found by name in
    any case, ``close`` before ``adj close``."""
    by_name = {c.lower(): c for c in reversed(raw.columns)}
    column = by_name.get("close") or by_name.get("adj close")
    if column is None:
        raise ValueError("vendor frame has no Close column.")
    return raw.select(
        *keep, F.col(ts).cast("timestamp").alias("timestamp"), F.col(f"`{column}`").cast("double").alias("close"), F.lit(source).alias("source")
    )


def check_schema(df: DataFrame, ts: str = "timestamp") -> None:
    """The part of the contract that needs no data: a timestamp key and a float64 close."""
    fields = {f.name: f.dataType for f in df.schema}
    if not isinstance(fields.get(ts), T.TimestampType):
        raise ValueError(f"expected {ts!r} to be a (UTC) timestamp.")
    if "close" not in fields:
        raise ValueError("expected a 'close' column.")
    if not isinstance(fields["close"], T.DoubleType):
        raise ValueError(f"expected 'close' to be double, got {fields['close'].simpleString()}.")


def validate_series(df: DataFrame, keys: list[str], ts: str = "timestamp", strict: bool = False) -> DataFrame:
    """Series that break the contract, with their number of rows holding any missing value."""
    check_schema(df, ts)
    missing = F.lit(False)
    for name, kind in df.dtypes:
        if name not in keys:
            missing = missing | F.col(name).isNull() | (F.isnan(name) if kind in ("double", "float") else F.lit(False))
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("bad_rows")).filter("bad_rows > 0")
    if strict:
        require_none(bad, "series with missing values")
    return bad


def pick_value_column(df: DataFrame, keys: tuple[str, ...] = ("ts", "asset")) -> DataFrame:
    """The one value of a series: ``close``, else ``value``, else the only column left."""
    rest = [c for c in df.columns if c not in keys]
    for name in ("close", "value"):
        if name in rest:
            return df.select(*[c for c in keys if c in df.columns], F.col(name).cast("double").alias("value"))
    if len(rest) != 1:
        raise ValueError(f"no 'close' or 'value' column and several others: {rest}")
    return df.select(*[c for c in keys if c in df.columns], F.col(rest[0]).cast("double").alias("value"))


def vintage_as_of(revisions: DataFrame, as_of, start, end, keys: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """What was known at ``as_of``: per observation date the latest revision published by then."""
    keys = keys or ["ticker"]
    latest = F.struct("realtime_start", tie) if tie else F.col("realtime_start")
    known = revisions.filter(
        (F.col("realtime_start") <= F.lit(as_of).cast("timestamp"))
        & F.col("obs_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    return known.groupBy(*keys, "obs_date").agg(F.max_by("value", latest).alias("close"))


def sanitise_key(ticker: Column) -> Column:
    """Characters a store key may not hold become underscores."""
    return F.translate(ticker, KEY_REPLACED, "_" * len(KEY_REPLACED))


def key_collisions(tickers: DataFrame, column: str = "ticker") -> DataFrame:
    """Store keys that more than one ticker maps to."""
    keyed = tickers.select(column).distinct().withColumn("store_key", sanitise_key(F.col(column)))
    return keyed.groupBy("store_key").agg(F.count(F.lit(1)).alias("n_tickers")).filter("n_tickers > 1")


def route_source(variables: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``source_key`` (lower case) and ``vendor_id`` (``series_id``, else ``ticker``)."""
    routed = variables.withColumns({"source_key": F.lower("source"), "vendor_id": F.coalesce("series_id", "ticker")})
    if strict:
        require_none(routed.filter("source_key is null or vendor_id is null").select("name"), "variables without a route")
    return routed
