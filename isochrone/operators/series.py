"""Windows along one series, without letting one long series become one long task.

Rows are unique on ``(keys, ts)``. Two cases:

* ``ts`` is a DATE. A series then holds at most one row per day (366 a year), whatever the skew of
  the raw data below it, so a plain window per series is bounded by the type.
* ``ts`` is a TIMESTAMP. A series may be arbitrarily long, so it is cut into blocks. Bounded frames
  carry a halo of neighbouring rows into each block (still one shuffle); unbounded frames run
  inside the block and add the totals of the earlier blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.spark import is_date

BLOCK_ROWS = 1 << 16
BLOCK_SPAN = "month"

_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


def with_positions(df: DataFrame, keys: list[str], ts: str = "ts", span: str = BLOCK_SPAN) -> DataFrame:
    """Add ``pos``, the 0-based row index in the series: index inside a time span plus the number
    of rows in the spans before it."""
    if is_date(df, ts):
        return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1)
    spanned = df.withColumn("_span", F.date_trunc(span, ts))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(_START, -1)
    starts = (
        spanned.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(ts)
    return (
        spanned.join(starts, [*keys, "_span"])
        .withColumn("pos", F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_span", "_before")
    )


def with_windows(
    df: DataFrame,
    keys: list[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    ts: str = "ts",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``build`` receives the ordered window and returns the new columns.
    """
    if is_date(df, ts):
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(ts)))
    placed = df if "pos" in df.columns else with_positions(df, keys, ts)
    n = F.lit(block_rows)
    first = F.greatest(F.floor((F.col("pos") - after) / n), F.lit(0))
    last = F.floor((F.col("pos") + before) / n)
    halo = placed.withColumn("_block", F.explode(F.sequence(first, last)))
    out = (
        halo.withColumns(build(Window.partitionBy(*keys, "_block").orderBy("pos")))
        .filter(F.floor(F.col("pos") / n) == F.col("_block"))
        .drop("_block")
    )
    return out if "pos" in df.columns else out.drop("pos")


_KINDS = {
    # kind: (aggregate over rows in ts order, how the earlier total joins the running value)
    "sum": (lambda x, ts: F.sum(x), lambda local, prior: F.coalesce(prior, F.lit(0.0)) + local),
    "max": (lambda x, ts: F.max(x), lambda local, prior: F.greatest(local, prior)),
    "min": (lambda x, ts: F.min(x), lambda local, prior: F.least(local, prior)),
    "product": (lambda x, ts: F.product(x), lambda local, prior: F.coalesce(prior, F.lit(1.0)) * local),
    "last": (lambda x, ts: F.max_by(x, F.when(x.isNotNull(), ts)), lambda local, prior: F.coalesce(local, prior)),
}


def _running_over(kind: str, x: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(x, ignorenulls=True).over(w)
    return _KINDS[kind][0](x, None).over(w)


def running(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, tuple[str, Column]],
    ts: str = "ts",
    span: str = BLOCK_SPAN,
) -> DataFrame:
    """Add running values from the start of each series up to the row.

    ``columns`` maps a name to ``(kind, column)``; kinds are sum, max, min, product and last
    (last = most recent non-missing value).
    """
    if is_date(df, ts):
        w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(_START, 0)
        return df.withColumns({name: _running_over(kind, x, w) for name, (kind, x) in columns.items()})
    spanned = df.withColumn("_span", F.date_trunc(span, ts)).withColumns(
        {f"_x_{name}": x for name, (_, x) in columns.items()}
    )
    totals = spanned.groupBy(*keys, "_span").agg(
        *[_KINDS[kind][0](F.col(f"_x_{name}"), F.col(ts)).alias(f"_t_{name}") for name, (kind, _) in columns.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(_START, -1)
    priors = totals.select(
        *keys, "_span",
        *[_running_over(kind, F.col(f"_t_{name}"), earlier).alias(f"_p_{name}") for name, (kind, _) in columns.items()],
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(ts).rowsBetween(_START, 0)
    out = spanned.join(priors, [*keys, "_span"]).withColumns(
        {
            name: _KINDS[kind][1](_running_over(kind, F.col(f"_x_{name}"), inside), F.col(f"_p_{name}"))
            for name, (kind, _) in columns.items()
        }
    )
    return out.select(*[c for c in df.columns if c not in columns], *columns)


def carry_forward(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Replace missing values by the last one seen, without limit."""
    out = running(df, keys, {f"_f_{c}": ("last", F.col(c)) for c in columns}, ts)
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def trailing_moments(df: DataFrame, keys: list[str], value: str, rows: int, mean: str, std: str, ts: str = "ts") -> DataFrame:
    """Add mean and deviation of the last ``rows`` rows, missing until all of them are present.

    For long windows: the series is cut into parts of ``rows`` rows, so a window is the end of one part and the
    start of the next. Both are running moments, merged around their means; the work per row does not grow with
    the window, as that of a sliding frame does. A constant window has the deviation zero.
    """
    x, n = F.col(value), F.lit(rows)
    placed = df if "pos" in df.columns else with_positions(df, keys, ts)
    part = Window.partitionBy(*keys, "_part")

    def moments(w: WindowSpec) -> Column:
        count = F.count(x).over(w)
        return F.struct(count.alias("n"), F.avg(x).over(w).alias("mean"), (F.var_pop(x).over(w) * count).alias("m2"), F.min(x).over(w).alias("low"), F.max(x).over(w).alias("high"))

    ends = placed.withColumn("_part", F.floor(F.col("pos") / n)).withColumns({
        "_head": moments(part.orderBy("pos").rowsBetween(_START, 0)), "_tail": moments(part.orderBy(F.desc("pos")).rowsBetween(_START, 0)),
    })
    # the last row of a part has its whole window in that part
    earlier = with_windows(ends, keys, lambda w: {"_tail": F.when((F.col("pos") + 1) % n != 0, F.lag("_tail", rows - 1).over(w))}, before=rows - 1, ts=ts)
    a, b = F.coalesce("_tail.n", F.lit(0)), F.col("_head.n")
    gap = F.when(a > 0, F.col("_head.mean") - F.col("_tail.mean")).otherwise(0.0)
    m2 = F.coalesce("_tail.m2", F.lit(0.0)) + F.col("_head.m2") + gap * gap * a * b / n
    flat = F.least("_tail.low", "_head.low") == F.greatest("_tail.high", "_head.high")
    full = a + b >= rows
    out = earlier.withColumns({
        mean: F.when(full, F.col("_head.mean") - gap * a / n),
        std: F.when(full & flat, 0.0).when(full, F.sqrt(m2 / (n - 1))),
    }).drop("_part", "_head", "_tail")
    return out if "pos" in df.columns else out.drop("pos")


# Columns for use inside ``with_windows``.


def full_window(agg: Callable[[Column], Column], x: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """``agg`` over the last ``rows`` rows, missing until ``least`` (default all) are present."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) >= (rows if least is None else least), agg(x).over(frame))


def rolling_mean(x: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return full_window(F.avg, x, w, rows, least)


def rolling_std(x: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return full_window(F.stddev_samp, x, w, rows, least)
