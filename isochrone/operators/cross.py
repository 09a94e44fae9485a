"""Cross-sections: ranks, selections and totals inside one date (or any other group).

``bound`` is a checked upper limit on the rows of one group, e.g. the row count of the asset
dimension. When it is given and small, one window per group is enough. Otherwise the group is
ordered in two levels: values are first collapsed to distinct cells (so a value shared by most rows
is one cell), cells go into logarithmic value buckets, and each bucket starts from the totals of
the buckets below it. The buckets are a fixed function of the value, so recomputing a lost task
always puts a row into the same bucket. This reads its input more than once, so the input is
written to the shared folder first instead of being computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import rank_correlation
from ..functions.spark import materialise

MAX_WINDOW_ROWS = 1_000_000
BUCKETS_PER_E_FOLD = 4096
ASSETS_PER_CELL = 1 << 16
NAME_PREFIX = 12


def fits_window(bound: int | None) -> bool:
    return bound is not None and bound <= MAX_WINDOW_ROWS


def value_bucket(x: Column) -> Column:
    """Order-preserving bucket: sign first, then the logarithm of the size."""
    size = F.floor(F.ln(F.abs(x)) * BUCKETS_PER_E_FOLD)
    return (
        F.when(x > 0, F.struct(F.lit(1).alias("sign"), size.alias("size")))
        .when(x < 0, F.struct(F.lit(-1).alias("sign"), (-size).alias("size")))
        .when(x == 0, F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("size")))
    )


def _tie_cell(df: DataFrame, tie: str) -> Column:
    """Order-preserving coarse cell of the tie-break column: ranges of numeric ids, or name prefixes
    (very wide universes should use numeric ids, whose cells have a fixed size)."""
    if isinstance(df.schema[tie].dataType, T.StringType):
        return F.substring(F.col(tie), 1, NAME_PREFIX)
    return F.floor(F.col(tie) / ASSETS_PER_CELL)


def rank_within(df: DataFrame, by: list[str], value: str, out: str, bound: int | None = None, size: str | None = None) -> DataFrame:
    """Add the ascending rank of ``value`` inside each group, ties averaged; missing stays missing.

    ``size`` also adds the number of present values of the group.
    """
    if fits_window(bound):
        w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
        # rank() counts the smaller values, the running range count includes the ties
        rank = (F.rank().over(w) + F.count(value).over(w)) / F.lit(2.0)
        new = {out: F.when(F.col(value).isNotNull(), rank)}
        if size:
            new[size] = F.count(value).over(Window.partitionBy(*by))
        return df.withColumns(new)
    df = materialise(df, "rank")
    cells = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(F.col(value)))
    )
    ranked = _below(cells, by, [F.col(value).asc()], {"_below": F.col("_n")}).select(
        *by, value, (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(out)
    )
    joined = df.join(ranked, [*by, value], "left")
    if size:
        sizes = df.groupBy(*by).agg(F.count(value).alias(size))
        joined = joined.join(sizes, by)
    return joined.select(*df.columns, out, *([size] if size else []))


def _below(cells: DataFrame, by: list[str], order: list[Column], measures: dict[str, Column]) -> DataFrame:
    """Add, per measure, its total over the cells that precede in bucket order, then in ``order``."""
    totals = cells.groupBy(*by, "_b").agg(*[F.sum(m).alias(f"_s{name}") for name, m in measures.items()])
    lower = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_b", *[F.coalesce(F.sum(f"_s{name}").over(lower), F.lit(0)).alias(f"_p{name}") for name in measures]
    )
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(starts, [*by, "_b"]).withColumns(
        {name: F.col(f"_p{name}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for name, m in measures.items()}
    )


def order_within(
    df: DataFrame,
    by: list[str],
    value: str,
    tie: str,
    out: str,
    before: str | None = None,
    ascending: bool = True,
    bound: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row when the group is sorted by ``(value, tie)``.

    Missing values get no position. ``before`` also adds the sum of the values sorted earlier.
    With ``ascending=False`` both the value and the tie-break are reversed.
    """
    v, t = F.col(value), F.col(tie)
    if fits_window(bound):
        w = Window.partitionBy(*by).orderBy(*([v.asc_nulls_last(), t.asc()] if ascending else [v.desc_nulls_last(), t.desc()]))
        new = {out: F.when(v.isNotNull(), F.row_number().over(w))}
        if before:
            new[before] = F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return df.withColumns(new)
    key = v if ascending else -v
    df = materialise(df, "order")
    rows = df.withColumn("_t", _tie_cell(df, tie))
    cells = (
        rows.filter(v.isNotNull())
        .groupBy(*by, value, "_t").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(key))
    )
    direction = (lambda c: c.asc()) if ascending else (lambda c: c.desc())
    placed = _below(
        cells, by, [direction(v), direction(F.col("_t"))],
        {"_rows": F.col("_n"), "_total": F.col("_n") * v},
    ).select(*by, value, "_t", "_rows", "_total")
    inside = Window.partitionBy(*by, value, "_t").orderBy(direction(t))
    joined = rows.join(placed, [*by, value, "_t"], "left")
    place = F.when(v.isNotNull(), F.row_number().over(inside))
    new = {out: (F.col("_rows") + place).cast("int")}
    if before:
        new[before] = F.coalesce(F.col("_total") + (place - 1) * v, F.lit(0.0))
    return joined.withColumns(new).select(*[c for c in df.columns], *new)


def totals_within(df: DataFrame, by: list[str], aggs: dict[str, Column], bound: int | None = None) -> DataFrame:
    """Add group totals to every row.

    Small groups use one window; otherwise a grouped aggregate (combined map-side, so a hot group
    costs nothing) is joined back, where adaptive execution splits or broadcasts as sizes demand.
    """
    if fits_window(bound):
        w = Window.partitionBy(*by)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    totals = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return df.join(totals, by)


def median_within(df: DataFrame, by: list[str], value: str, tie: str, out: str, bound: int | None = None) -> DataFrame:
    """One exact median per group: the middle position, or the mean of the two middle ones."""
    if fits_window(bound):
        return df.groupBy(*by).agg(F.median(value).alias(out))
    placed = order_within(df.select(*by, value, tie).filter(F.col(value).isNotNull()), by, value, tie, "_i")
    sized = totals_within(placed, by, {"_n": F.count(F.lit(1))})
    middle = (F.col("_i") * 2 >= F.col("_n")) & (F.col("_i") * 2 <= F.col("_n") + 2)
    return sized.filter(middle).groupBy(*by).agg(F.avg(value).alias(out))


def cross_ic(df: DataFrame, by: list[str], x: str, y: str, out: str = "ic", bound: int | None = None) -> DataFrame:
    """Spearman correlation per group; missing for fewer than two pairs or a constant side."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rank_within(rank_within(pairs, by, x, "_rx", bound), by, y, "_ry", bound)
    return ranked.groupBy(*by).agg(rank_correlation(F.col("_rx"), F.col("_ry")).alias(out))
