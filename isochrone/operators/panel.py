"""Calendars, dense panels, as-of sampling and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numeric import missing_if_not_finite
from ..functions.spark import is_date, require_none, require_rows
from .series import carry_forward, running, with_positions


def utc_normalise(df: DataFrame, column: str = "ts") -> DataFrame:
    """Any date or timestamp column becomes ``timestamp`` (UTC session zone). Rows are not ordered: time
    order is a matter of windows and of sinks, which sort inside their partitions."""
    return df.withColumn("timestamp", F.col(column).cast("timestamp")).drop(*([] if column == "timestamp" else [column]))


def in_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Inclusive dates: from ``start`` up to, but not at, the day after ``end``."""
    return df.filter((F.col(ts) >= F.lit(start).cast("date")) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1)))


def calendar_union(df: DataFrame, start=None, end=None, ts: str = "ts", strict: bool = False) -> DataFrame:
    """Distinct timestamps of all series in ``[start, end]``."""
    out = df.select(ts)
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col(ts) <= F.lit(end).cast("date"))
    out = out.distinct()
    return require_rows(out, "No overlapping calendar dates in the requested range.") if strict else out


def business_calendar(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row per Mon-Fri day of each ``[first, last]`` range."""
    return bounds.withColumn("ts", F.explode(D.period_sequence(F.col(first), F.col(last), "daily")))


def index_intersection(*frames: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamps present in every frame."""
    out = frames[0].select(ts).distinct()
    for frame in frames[1:]:
        out = out.intersect(frame.select(ts))
    return out


def _days_literal(days: DataFrame, column: str) -> Column:
    """Sorted array of the distinct days of a table as a scalar subquery (days are few by type)."""
    return days.agg(F.sort_array(F.collect_set(column))).scalar()


def dense_panel(df: DataFrame, keys: list[str] | None = None, ts: str = "ts", scope: list[str] | None = None) -> DataFrame:
    """Every key at every timestamp that any key has; absent values stay missing.

    ``scope`` columns (fold, path, ...) each keep their own calendar.
    """
    keys = keys or ["asset"]
    scope = scope or []
    owners = df.select(*scope, *keys).distinct()
    if scope:
        day = ts if is_date(df, ts) else "_day"
        ticks = df.select(*scope, ts).distinct()
        if not is_date(df, ts):
            ticks = ticks.withColumn("_day", F.to_date(ts))
        grid = owners.join(ticks.groupBy(*scope, *([] if day == ts else [day])).agg(F.collect_set(ts).alias("_t")), scope)
        grid = grid.withColumn(ts, F.explode("_t")).select(*scope, *keys, ts)
    elif is_date(df, ts):
        grid = owners.withColumn(ts, F.explode(_days_literal(df, ts)))
    else:
        ticks = df.select(ts).distinct().withColumn("_day", F.to_date(ts))
        by_day = ticks.groupBy("_day").agg(F.collect_set(ts).alias("_t"))
        grid = (
            owners.withColumn("_day", F.explode(_days_literal(df.select(F.to_date(ts).alias("_day")), "_day")))
            .join(by_day, "_day").withColumn(ts, F.explode("_t")).select(*keys, ts)
        )
    return grid.join(df, [*scope, *keys, ts], "left").select(*df.columns)


def price_panel(prices: DataFrame, start=None, end=None, value: str = "value", scope: list[str] | None = None) -> DataFrame:
    """Dense panel on the calendar of ``[start, end]``, carried forward, then zero becomes missing."""
    ranged = prices
    if start is not None:
        ranged = ranged.filter(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        ranged = ranged.filter(F.col("ts") <= F.lit(end).cast("date"))
    dense = dense_panel(ranged, scope=scope)
    filled = carry_forward(dense, [*(scope or []), "asset"], [value])
    return filled.withColumn(value, F.nullif(F.col(value), F.lit(0.0)))


def last_print(calendar: DataFrame, prints: DataFrame, ts: str = "ts", scope: list[str] | None = None) -> DataFrame:
    """For each calendar date the latest print date not after it (``print_ts``), in any series."""
    keys = [*(scope or []), "_all"]
    marks = (
        calendar.select(*(scope or []), ts, F.lit(True).alias("_wanted"))
        .unionByName(prints.select(*(scope or []), ts).distinct().withColumn("_wanted", F.lit(False)))
        .groupBy(*(scope or []), ts)
        .agg(F.max("_wanted").alias("_wanted"), F.max(F.when(~F.col("_wanted"), F.col(ts))).alias("_print"))
        .withColumn("_all", F.lit(1))
    )
    return (
        running(marks, keys, {"print_ts": ("last", F.col("_print"))}, ts)
        .filter("_wanted").select(*(scope or []), ts, "print_ts")
    )


def asof_signal(
    signal: DataFrame, calendar: DataFrame, instruments: DataFrame, scope: list[str] | None = None
) -> DataFrame:
    """Panel signal at every calendar date: the cross-section of the last signal date not after it.

    An instrument absent from that cross-section, or a date before any signal, gives zero.
    """
    scope = scope or []
    grid = _every_instrument(instruments, last_print(calendar, signal, scope=scope), scope)
    values = signal.select(*scope, F.col("ts").alias("print_ts"), "asset", "value")
    return grid.join(values, [*scope, "print_ts", "asset"], "left").select(
        *scope, "ts", "asset", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def _every_instrument(instruments: DataFrame, dated: DataFrame, scope: list[str]) -> DataFrame:
    """Each instrument on each row of a per-date table: days go through one short array, the rows of
    a day are joined by equality."""
    days = dated.select(*scope, F.to_date("ts").alias("_day"))
    if scope:
        spread = instruments.join(days.groupBy(*scope).agg(F.collect_set("_day").alias("_days")), scope)
    else:
        spread = instruments.withColumn("_days", _days_literal(days, "_day"))
    by_day = spread.withColumn("_day", F.explode("_days")).drop("_days")
    return by_day.join(dated.withColumn("_day", F.to_date("ts")), [*scope, "_day"]).drop("_day")


def asof_broadcast(series: DataFrame, calendar: DataFrame, instruments: DataFrame) -> DataFrame:
    """Single-series signal at every calendar date, given to all instruments; zero before it starts."""
    latest = last_print(calendar, series).join(
        series.select(F.col("ts").alias("print_ts"), "value"), "print_ts", "left"
    )
    value = F.when(F.col("print_ts").isNull(), F.lit(0.0)).otherwise(F.col("value"))
    return _every_instrument(instruments, latest.select("ts", value.alias("value")), []).select("ts", "asset", "value")


def asof_ffill(
    prints: DataFrame,
    start,
    end,
    frequency: str = "daily",
    value: str = "value",
    strict: bool = False,
) -> DataFrame:
    """Coarse prints onto a finer grid from ``start`` to ``end``: last print not after each date.

    ``strict`` fails when a series' first print is later than ``start``.
    """
    if strict:
        late = prints.groupBy("asset").agg(F.min("ts").alias("first_print")).filter(F.col("first_print") > F.lit(start).cast("date"))
        require_none(late, "source does not cover the requested start")
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if frequency != "daily":
        # first label on or after start, last label on or before end
        first, last = D.period_end(first, frequency), D.period_end(last, frequency)
    labels = F.filter(D.period_sequence(first, last, frequency, "end"), lambda d: d <= F.lit(end).cast("date"))
    grid = prints.select("asset").distinct().withColumn("ts", F.explode(labels)).select(
        "asset", "ts", F.lit(None).cast("double").alias(value), F.lit(True).alias("_target")
    )
    both = (
        prints.select("asset", "ts", value, F.lit(False).alias("_target")).unionByName(grid)
        .groupBy("asset", "ts").agg(F.max(value).alias(value), F.max("_target").alias("_target"))
    )
    return carry_forward(both, ["asset"], [value]).filter("_target").drop("_target")


def pair_align(signal: DataFrame, forward: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows where both the signal and the forward return are present."""
    return signal.filter(F.col("signal").isNotNull()).join(
        forward.filter(F.col("fwd").isNotNull()), on or ["ts", "asset"]
    )


def difference(lhs: DataFrame, rhs: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """lhs - rhs on the union of timestamps; missing on either side gives missing."""
    on = keys or ["ts"]
    left = lhs.select(*on, F.col(value).alias("_l"))
    right = rhs.select(*on, F.col(value).alias("_r"))
    return left.join(right, on, "full").select(*on, (F.col("_l") - F.col("_r")).alias(value))


def benchmark_align(benchmark: DataFrame, strategies: DataFrame) -> DataFrame:
    """Benchmark and strategies on the dates where every strategy and the benchmark are finite.

    ``benchmark(ts, ret)``, ``strategies(ts, config, ret)``.
    """
    bench = benchmark.select("ts", missing_if_not_finite(F.col("ret")).alias("bench")).filter("bench is not null")
    strat = strategies.withColumn("ret", missing_if_not_finite(F.col("ret")))
    n = strat.agg(F.count_distinct("config")).scalar()
    complete = strat.groupBy("ts").agg(F.count("ret").alias("_n")).filter(F.col("_n") == n).select("ts")
    return strat.join(complete, "ts", "left_semi").join(bench, "ts").select("ts", "config", "ret", "bench")


def no_lookahead(df: DataFrame, as_of, method: str = "expanding", train_window: int = 0) -> DataFrame:
    """Rows up to ``as_of``; in rolling mode only the last ``train_window`` of each series."""
    known = df.filter(F.col("ts") <= F.lit(as_of).cast("date"))
    if method != "rolling" or train_window <= 0:
        return known
    placed = with_positions(known, ["asset"])
    length = known.groupBy("asset").agg(F.count(F.lit(1)).alias("_len"))
    return placed.join(length, "asset").filter(F.col("pos") >= F.col("_len") - train_window).drop("pos", "_len")


def restrict_timestamps(df: DataFrame, dates: DataFrame, on: list[str] | None = None) -> DataFrame:
    return df.join(dates, on or ["ts"], "left_semi")


def check_test_dates(requested: DataFrame, calendar: DataFrame, strict: bool = False) -> DataFrame:
    """Requested test dates, deduplicated; dates outside the calendar are reported or refused."""
    wanted = requested.select("ts").distinct()
    if strict:
        require_none(wanted.join(calendar, "ts", "left_anti"), "test dates not in the calendar")
    return wanted.join(calendar.select("ts", F.lit(True).alias("in_calendar")), "ts", "left").select(
        "ts", F.coalesce("in_calendar", F.lit(False)).alias("in_calendar")
    )


def tail_window(calendar: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` dates of a calendar."""
    return calendar.select("ts").distinct().orderBy(F.desc("ts")).limit(rows)


def train_test_complement(calendar: DataFrame, test: DataFrame) -> DataFrame:
    return calendar.join(test, "ts", "left_anti")


def publication_lag(df: DataFrame, business_days: int = 30) -> DataFrame:
    """Make each value available ``business_days`` Mon-Fri days later.

    Prints whose shifted dates coincide (weekend and Friday) keep the latest original one.
    """
    shifted = df.withColumn("_origin", F.col("ts")).withColumn("ts", D.add_business_days(F.to_date("ts"), business_days))
    return shifted.groupBy("asset", "ts").agg(F.max_by("value", "_origin").alias("value"))


def signal_combine(signals: DataFrame, n_signals: int) -> DataFrame:
    """Equal-weight combination of ``(signal, ts, asset, value)``: sum over signals / number of
    signals; a missing side counts as zero unless all are missing."""
    return signals.groupBy("ts", "asset").agg((F.sum("value") / F.lit(float(n_signals))).alias("value"))


def instrument_union(declared: DataFrame) -> DataFrame:
    """Distinct instruments of ``(signal_order, position, asset)`` in first-mention order."""
    first = F.min(F.struct("signal_order", "position"))
    return declared.groupBy("asset").agg(first.alias("_first")).select(
        "asset", F.col("_first.signal_order").alias("signal_order"), F.col("_first.position").alias("position")
    )


def instrument_prices(prices: DataFrame, instruments: DataFrame, strict: bool = False) -> DataFrame:
    """Prices of the declared instruments; undeclared data is dropped, missing data refused."""
    if strict:
        require_none(instruments.join(prices.select("asset").distinct(), "asset", "left_anti"), "missing price series")
    return prices.join(instruments, "asset", "left_semi")


def quote_orientation(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(pair, spot, invert)``: price of each pair, inverted where quoted the other way round."""
    return prices.join(pairs.withColumnRenamed("spot", "asset"), "asset").select(
        "ts", F.col("pair").alias("asset"),
        F.when(F.col("invert"), F.try_divide(F.lit(1.0), F.col("value"))).otherwise(F.col("value")).alias("value"),
    )


def fx_pairs(currencies: DataFrame, base: str, strict: bool = False) -> DataFrame:
    """(quote, base) for every other currency."""
    if strict:
        require_rows(currencies.filter(F.col("ccy") == base), f"base currency {base!r} not in universe")
    return currencies.filter(F.col("ccy") != base).select(
        F.concat_ws("/", "ccy", F.lit(base)).alias("pair"), F.col("ccy").alias("quote"), F.lit(base).alias("base")
    )

