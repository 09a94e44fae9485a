"""Cache-first ingestion: what is covered is read, the rest is fetched, checked and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.frequency import publication_lag_col
from ..functions.spark import materialise, require_none
from ..operators.clean import clean_series
from .layers import LayerStore

# Slack at the start of a request, and the version cleaning writes.
START_SLACK_BUSINESS_DAYS = 5
CLEAN_VERSION = 1
KEY = ["source", "ticker", "frequency"]


def series_ranges(stored: DataFrame) -> DataFrame:
    return stored.groupBy(*KEY).agg(F.min("ts").alias("cached_start"), F.max("ts").alias("cached_end"))


def coverage_check(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """Add ``covered`` to ``requests(source, ticker, frequency, start, end)``.

    A stored range covers a request when it starts within five business days of the first one asked
    for and ends no earlier than the last one minus the publication lag. A request without business
    days is covered by any stored series.
    """
    first, last = D.first_business_day(F.col("start")), D.last_business_day(F.col("end"))
    lag = F.greatest(F.lit(1), publication_lag_col(F.col("frequency")))
    holds = (F.col("cached_start") <= D.add_business_days(first, START_SLACK_BUSINESS_DAYS)) & (F.col("cached_end") >= F.date_sub(last, lag))
    joined = requests.join(ranges, KEY, "left")
    known = F.col("cached_start").isNotNull() & F.col("cached_end").isNotNull()
    return joined.withColumn("covered", F.coalesce(known & ((first > last) | holds), F.lit(False))).select(*requests.columns, "covered")


def superset_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whether each new range may replace the stored one: ``accepted`` when it contains it (or
    nothing is stored yet). Both inputs are ``(key..., ts, ...)``."""
    return superset_of_ranges(series_ranges(old), new)


def superset_of_ranges(ranges: DataFrame, new: DataFrame) -> DataFrame:
    """``superset_guard`` where the stored ranges are known, ``(key..., cached_start, cached_end)``."""
    have = ranges.select(*KEY, F.col("cached_start").alias("old_start"), F.col("cached_end").alias("old_end"))
    come = new.groupBy(*KEY).agg(F.min("ts").alias("new_start"), F.max("ts").alias("new_end"))
    contains = (F.col("new_start") <= F.col("old_start")) & (F.col("new_end") >= F.col("old_end"))
    return come.join(have, KEY, "left").withColumn("accepted", F.coalesce(contains, F.lit(True)))


def incremental_ingest(store: LayerStore, landing: DataFrame, requests: DataFrame, force_refresh: bool = False, fill_limit: int = 3) -> DataFrame:
    """Serve requests from the raw layer where covered; otherwise take the landed rows of the
    requested range, store them raw (replacing only by a superset) and cleaned as version 1.

    Returns one status per request: ``covered``, ``stored``, ``rejected`` (not a superset),
    ``raw_only`` (cleaning refused the series) or ``no_data``.
    """
    # what is stored, from the manifest: the layer itself is not read
    ranges = materialise(store.series("raw").select(*KEY, F.col("first").alias("cached_start"), F.col("last").alias("cached_end")), "ranges")
    checked = requests.withColumn("covered", F.lit(False)) if force_refresh else coverage_check(ranges, requests)
    # decisions are written down before the layers they were read from change
    checked = materialise(checked, "coverage")
    wanted = checked.filter(~F.col("covered")).select(*KEY, "start", "end")
    asked = wanted.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("start").alias("_start"), F.col("end").alias("_end"))
    # a landed row is taken once, however many overlapping requests ask for it
    inside = [F.col(k) == F.col(f"_{k}") for k in KEY] + [F.col("ts") >= F.col("_start"), F.col("ts") <= F.col("_end")]
    fetched = materialise(landing.join(asked, inside, "left_semi"), "fetched")
    guard = materialise(superset_of_ranges(ranges, fetched).select(*KEY, "accepted"), "guard")
    # every fetched series has its row in the guard; those refused are the fewer
    accepted = fetched.join(guard.filter("NOT accepted").select(*KEY), KEY, "left_anti")
    store.replace_raw(accepted)
    written = store.write_adjusted(clean_series(accepted, fill_limit, keys=KEY), CLEAN_VERSION)
    kept = written.select(*KEY, F.lit(True).alias("_cleaned"))
    status = (
        F.when(F.col("covered"), "covered").when(F.col("accepted").isNull(), "no_data").when(~F.col("accepted"), "rejected")
        .when(F.col("_cleaned"), "stored").otherwise("raw_only")
    )
    return checked.join(guard, KEY, "left").join(kept, KEY, "left").select(*requests.columns, status.alias("status"))


def fetch_or_load(
    store: LayerStore, landing: DataFrame, requests: DataFrame, layer: str = "raw", force_refresh: bool = False, fill_limit: int = 3, strict: bool = False
) -> DataFrame:
    """Rows of the wanted layer for ``requests(source, ticker, frequency, start, end)``, stored first where they
    are not yet: all requests in one pass, a row once however many requests it answers.

    A request that cannot be served (nothing landed, a refused replacement, in the adjusted layer a series that
    cleaning refused) gives no rows; with ``strict`` it is an error that names the series.
    """
    if layer not in ("raw", "adjusted"):
        raise ValueError(f"rows are served from the raw or the adjusted layer, not from {layer!r}.")
    served = materialise(incremental_ingest(store, landing, requests, force_refresh, fill_limit), "served")
    if strict:
        refused = ["no_data", "rejected", *(["raw_only"] if layer == "adjusted" else [])]
        require_none(served.filter(F.col("status").isin(refused)).select(*KEY, "status"), "series that cannot be served")
    if not store.exists(layer):
        return landing.limit(0)
    rows = store.read(layer, version=CLEAN_VERSION if layer == "adjusted" else None, among=requests.select(*KEY).distinct())
    asked = requests.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = [F.col(k) == F.col(f"_{k}") for k in KEY] + [F.col("ts") >= F.col("_start"), F.col("ts") < F.date_add("_end", 1)]
    return rows.join(asked, inside, "left_semi")
