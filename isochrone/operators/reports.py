"""Report tables. Long results become wide only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numeric import ratio
from .series import running

# Labels and order of the summary, and the low-count flag.
SUMMARY_ROWS = (
    ("Annualised return", "annualised_return", "percent"),
    ("Annualised vol", "annualised_vol", "percent"),
    ("Sharpe", "sharpe_ratio", "number"),
    ("Sortino", "sortino_ratio", "number"),
    ("Max drawdown", "max_drawdown", "percent"),
    ("Max drawdown duration", "max_drawdown_duration", "periods"),
    ("Hit rate", "hit_rate", "percent"),
    ("Total cost bps", "total_cost_bps", "number"),
    ("Turnover", "turnover_annual", "number"),
)
LOW_N = 20


def aligned_returns(returns: DataFrame) -> DataFrame:
    """Dates with a gross return; a missing net return is zero."""
    return returns.filter(F.col("gross").isNotNull()).withColumn("net", F.coalesce("net", F.lit(0.0)))


def monthly_returns(returns: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    """Compounded return per month; months without rows inside the span give zero."""
    months = returns.groupBy(*keys, D.period_end(F.col("ts"), "monthly").alias("month")).agg((F.product(F.lit(1.0) + F.col(ret)) - 1).alias("ret"))
    spans = months.groupBy(*keys).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    grid = spans.withColumn("month", F.explode(D.period_sequence(F.col("_a"), F.col("_b"), "monthly", "end"))).drop("_a", "_b")
    return grid.join(months, [*keys, "month"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def monthly_returns_matrix(returns: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    """Year by month 1..12."""
    monthly = monthly_returns(returns, keys, ret).withColumn("m", F.month("month"))
    year = F.year("month").alias("year")
    return monthly.groupBy(*keys, year).pivot("m", list(range(1, 13))).agg(F.first("ret"))


def monthly_cost_bps(returns: DataFrame, keys: list[str]) -> DataFrame:
    cost = (F.col("gross") - F.col("net")) * 10000
    return aligned_returns(returns).groupBy(*keys, F.last_day("ts").alias("month")).agg(F.sum(cost).alias("cost_bps"))


def gross_net_curves(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative gross and net return on the dates with a gross return."""
    curves = running(
        aligned_returns(returns), keys,
        {"_g": ("product", F.lit(1.0) + F.col("gross")), "_n": ("product", F.lit(1.0) + F.col("net"))},
    )
    return curves.select(*keys, "ts", (F.col("_g") - 1).alias("gross_curve"), (F.col("_n") - 1).alias("net_curve"))


def _formatted(column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == "percent":
        text = F.format_string("%.2f%%", c * 100)
    elif kind == "periods":
        text = F.format_string("%d periods", c.cast("int"))
    else:
        text = F.format_string("%.2f", c)
    return F.when(c.isNotNull(), text).otherwise(F.lit("n/a"))


def summary_table(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics as formatted (position, label, value) rows."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), _formatted(column, kind).alias("value"))
        for i, (label, column, kind) in enumerate(SUMMARY_ROWS)
    ])
    return stats.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.position", "_r.label", "_r.value")


def corr_matrix(df: DataFrame, pairs: DataFrame | None = None, key: str = "asset", value: str = "value") -> DataFrame:
    """Pairwise-complete Pearson correlation ``(a, b, corr)`` of the series of a panel.

    With ``pairs(a, b)`` only those are computed: the panel is joined to the wanted pairs, then to the
    partner's rows, and reduced map-side. Without, every two series that share a date are, in both
    orders; that report has as many rows as pairs. Values are centred first to keep the sums exact.
    """
    present = df.filter(F.col(value).isNotNull())
    means = present.groupBy(key).agg(F.avg(value).alias("_m"))
    rows = present.join(means, key).select("ts", F.col(key).alias("_key"), (F.col(value) - F.col("_m")).alias("_x"))
    left = rows.select("ts", F.col("_key").alias("a"), F.col("_x").alias("x"))
    right = rows.select("ts", F.col("_key").alias("b"), F.col("_x").alias("y"))
    both = left.join(right, "ts") if pairs is None else left.join(pairs.select("a", "b").distinct(), "a").join(right, ["ts", "b"])
    x, y, n = F.col("x"), F.col("y"), F.count(F.lit(1))
    var = lambda c: F.sum(c * c) - F.sum(c) * F.sum(c) / n
    corr = ratio(F.sum(x * y) - F.sum(x) * F.sum(y) / n, F.sqrt(F.greatest(var(x) * var(y), F.lit(0.0))))
    return both.groupBy("a", "b").agg(F.when(n > 1, corr).alias("corr"))


def signal_heatmap_table(df: DataFrame, assets: list[str], value: str = "value") -> DataFrame:
    """Dates by assets; ``assets`` are the columns of the report."""
    return df.groupBy("ts").pivot("asset", assets).agg(F.first(value))


def metrics_report(metrics: DataFrame, low_n: int = LOW_N) -> DataFrame:
    """One line per signal, frequency and horizon, flagging small samples."""
    return metrics.withColumn("low_n", F.col("n_observations") < low_n)
