"""Null-safe numeric columns. Missing is NULL everywhere; NaN and infinities never leave here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal distribution function, Abramowitz & Stegun 26.2.17 (max error 7.5e-8).
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def missing_if_not_finite(x: Column) -> Column:
    """NaN and +-inf become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero."""
    return F.try_divide(num, den)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp, keeping NULL (greatest/least alone would drop it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation over the rows where both are present; NULL on a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def rank_correlation(rx: Column, ry: Column) -> Column:
    """Aggregate Pearson correlation of two average-rank columns over the same rows.

    Ranks average to (n + 1) / 2, so doubled ranks need only sums of integers: exact, independent
    of summation order, and a truly uncorrelated group is exactly zero.
    """
    n = F.count(rx).cast("double")
    mean = n * (n + 1) * (n + 1)
    vx, vy = F.sum(rx * rx * 4) - mean, F.sum(ry * ry * 4) - mean
    return ratio(F.sum(rx * ry * 4) - mean, F.sqrt(vx * vy))


def normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(NORMAL_P) * a)
    poly = F.lit(0.0)
    for b in reversed(NORMAL_B):
        poly = (poly + F.lit(b)) * t
    upper = F.lit(INV_SQRT_2PI) * F.exp(-a * a / F.lit(2.0)) * poly
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def r6(x: Column, digits: int = 6) -> Column:
    """Round at the edge of a query; adding zero turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)
