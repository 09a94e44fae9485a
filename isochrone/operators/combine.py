"""Weights of signals by how well, and how independently, each predicted in the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio

# Trailing rows that the weights look at, and signals that one solve takes.
WINDOW = 252
MOST_SIGNALS = 8
METHODS = ("equal", "icir", "penalised")


def solve(matrix: Column, right: Column, n: int) -> Column:
    """x of ``matrix x = right`` for a symmetric positive definite matrix of n rows, as an array; NULL when a
    pivot is not positive or anything is missing.

    Gauss-Jordan steps fold over the rows of the augmented matrix, all inside one expression; such a matrix needs
    no exchange of rows.
    """
    rows = F.transform(matrix, lambda row, i: F.concat(row, F.array(F.get(right, i))))

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(F.get(m, k), k)
        scaled = F.transform(F.get(m, k), lambda x: F.when(pivot > 0, x / pivot))
        return F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - F.get(row, k) * b)))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step)
    out = F.transform(solved, lambda row: F.get(row, F.lit(n)))
    return F.when(F.forall(out, lambda x: x.isNotNull() & ~F.isnan(x)), out)


def past_moments(ic: DataFrame, signals: list[str], window: int, lag: int, scope: list[str]) -> DataFrame:
    """(scope, ts, n, mean, cov): moments of the IC over the ``window`` rows that end ``lag`` rows before each date,
    of rows where all signals have one. ``mean`` is an array and ``cov`` an array of rows (sample covariance)."""
    per_signal = [F.max(F.when(F.col("signal") == s, F.col("ic"))).alias(f"x{i}") for i, s in enumerate(signals)]
    wide = ic.where(F.col("signal").isin(*signals)).groupBy(*scope, "ts").agg(*per_signal)
    xs = [f"x{i}" for i in range(len(signals))]
    whole = F.lit(True)
    for x in xs:
        whole = whole & F.col(x).isNotNull()
    past = Window.partitionBy(*scope).orderBy("ts").rowsBetween(-window - lag + 1, -lag)
    own = [F.when(whole, F.col(x)).alias(x) for x in xs]
    rows = wide.select(*scope, "ts", *own)
    sums = {"n": F.count("x0").over(past), **{f"s{x}": F.sum(x).over(past) for x in xs}}
    sums |= {f"p{i}_{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}")).over(past) for i in range(len(xs)) for j in range(i + 1)}
    rows = rows.withColumns(sums)
    at = lambda i, j: f"p{max(i, j)}_{min(i, j)}"
    cov = [F.array(*[ratio(F.col(at(i, j)) - F.col(f"sx{i}") * F.col(f"sx{j}") / F.col("n"), F.col("n") - 1) for j in range(len(xs))]) for i in range(len(xs))]
    return rows.select(*scope, "ts", "n", F.transform(F.array(*[F.col(f"s{x}") for x in xs]), lambda s: ratio(s, F.col("n"))).alias("mean"), F.array(*cov).alias("cov"))


def signal_weights(
    ic: DataFrame, signals: list[str], method: str = "penalised", window: int = WINDOW, lag: int = 2, shrink: float = 0.5, least: int = 12, scope: list[str] | None = None
) -> DataFrame:
    """(scope, signal, ts, weight) from ``ic(scope, signal, ts, ic)``; absolute weights of a date add up to one.

    ``equal``: 1 / n. ``icir``: in proportion to mean / deviation of the trailing IC. ``penalised``: in
    proportion to C^-1 mean, C the trailing covariance with its off-diagonal part reduced by ``shrink``: signals that
    are right at the same time share their weight. The IC of a date is known only after the return it is
    measured on, ``lag`` rows later at horizon 1. A date with fewer than ``least`` past rows, or moments that do not
    allow a solution, has equal weights.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}.")
    if not 1 <= len(signals) <= MOST_SIGNALS or len(set(signals)) != len(signals):
        raise ValueError(f"between 1 and {MOST_SIGNALS} different signals can be weighed.")
    if lag < 1:
        raise ValueError("weights may only look at past rows.")
    n, scope = len(signals), scope or []
    moments = past_moments(ic, signals, window, lag, scope)
    if method == "icir":
        raw = F.transform("mean", lambda m, i: ratio(m, F.sqrt(F.get(F.get("cov", i), i))))
    else:
        shrunk = F.transform("cov", lambda row, i: F.transform(row, lambda x, j: F.when(i == j, x).otherwise(x * F.lit(1.0 - shrink))))
        raw = solve(shrunk, F.col("mean"), n)
    equal = F.array(*[F.lit(1.0 / n)] * n)
    gross = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.abs(x))
    usable = F.lit(method != "equal") & (F.col("n") >= least) & (gross > 0)
    weighed = moments.withColumn("raw", raw).withColumn("weights", F.when(F.coalesce(usable, F.lit(False)), F.transform("raw", lambda x: x / gross)).otherwise(equal))
    named = F.posexplode(F.arrays_zip(F.array(*[F.lit(s) for s in signals]).alias("signal"), F.col("weights").alias("weight")))
    return weighed.select(*scope, "ts", named.alias("_pos", "_row")).select(*scope, "_row.signal", "ts", "_row.weight")


def weighted_combination(signals: DataFrame, weights: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, ts, asset, value): weighted sum of ``signals(scope, signal, ts, asset, value)``; a missing side counts
    as zero unless all are missing."""
    keys = [*(scope or []), "ts"]
    return signals.join(weights, [*keys, "signal"]).groupBy(*keys, "asset").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
