"""Walk-forward and combinatorial folds as small tables joined to dated rows."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import logit
from .cross import rank_within
from .series import with_positions

#: Decimals to which Sharpes are compared: paths that share their rows differ by the order of summation only.
TIE_DECIMALS = 9


def indexed_calendar(df: DataFrame) -> DataFrame:
    """Distinct dates with their 0-based index ``pos``."""
    return with_positions(df.select("ts").distinct().withColumn("_all", F.lit(1)), ["_all"]).select("ts", "pos")


def expanding_train_rows(calendar_rows: int, train: int, test: int) -> list[int]:
    folds = max(0, (calendar_rows - train) // test)
    return [train + k * test for k in range(folds)]


def rolling_train_rows(folds: int, train: int) -> list[int]:
    return [train] * folds


def walk_forward_folds(calendar: DataFrame, train: int, test: int, mode: str = "expanding") -> DataFrame:
    """``(fold, ts, is_test)``: test rows of fold k start at ``train + k * test``; history runs from
    row 0 (expanding) or from the ``train`` rows before the test block (rolling)."""
    if mode not in ("expanding", "rolling"):
        raise ValueError(f"unknown fold mode {mode!r}: expanding and rolling exist")
    placed = indexed_calendar(calendar)
    folds = placed.agg(F.floor((F.count(F.lit(1)) - train) / F.lit(test)).cast("int")).scalar()
    test_fold = F.floor((F.col("pos") - train) / F.lit(test)).cast("int")
    first = F.greatest(test_fold, F.lit(0))
    # a row is history of every later fold, or (rolling) of those whose window still reaches it
    last = folds - 1 if mode == "expanding" else F.least(folds - 1, F.floor(F.col("pos") / F.lit(test)).cast("int"))
    out = placed.filter(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    return out.select("fold", "ts", (F.col("pos") >= train + F.col("fold") * test).alias("is_test"))


def combinations_table(spark: SparkSession, n_groups: int, k_test: int, limit: int | None = None) -> DataFrame:
    """``(path, grp)``: the groups held out by each combination, in lexicographic order; the first
    ``limit`` combinations when the caller asks for fewer than all.

    A parameter table: its size depends on the fold settings only, never on the data.
    """
    if n_groups < 2:
        raise ValueError(f"{n_groups} group(s) cannot be split into held-out and other groups")
    if not 1 <= k_test <= n_groups:
        raise ValueError(f"{k_test} of {n_groups} groups cannot be held out")
    combos = itertools.islice(itertools.combinations(range(n_groups), k_test), limit)
    rows = [(path, group) for path, combo in enumerate(combos) for group in combo]
    return spark.createDataFrame(rows, "path int, grp int")


def cpcv_groups(calendar: DataFrame, n_groups: int) -> DataFrame:
    """``(ts, pos, grp)``: rows 1.. split into contiguous groups, the first ones a row longer where
    it does not divide; row 0 is warm-up and belongs to none."""
    placed = indexed_calendar(calendar)
    rows = placed.agg((F.count(F.lit(1)) - 1).cast("int")).scalar()
    sized = placed.withColumns({"_size": F.floor(rows / F.lit(n_groups)).cast("int"), "_long": rows % n_groups})
    i = F.col("pos") - 1
    boundary = F.col("_long") * (F.col("_size") + 1)
    group = F.when(i < boundary, F.floor(i / (F.col("_size") + 1))).otherwise(
        F.col("_long") + F.floor((i - boundary) / F.greatest(F.col("_size"), F.lit(1)))
    )
    return sized.select("ts", "pos", F.when(F.col("pos") > 0, group.cast("int")).alias("grp"))


def cpcv_folds(calendar: DataFrame, n_groups: int = 10, k_test: int = 2, limit: int | None = None) -> DataFrame:
    """``(path, ts, pos, is_test)`` for every combination and calendar row."""
    spark = calendar.sparkSession
    groups = cpcv_groups(calendar, n_groups)
    held = combinations_table(spark, n_groups, k_test, limit)
    n_paths = math.comb(n_groups, k_test) if limit is None else min(limit, math.comb(n_groups, k_test))
    rows = groups.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    return rows.join(held.withColumn("_held", F.lit(True)), ["path", "grp"], "left").select(
        "path", "ts", "pos", F.coalesce("_held", F.lit(False)).alias("is_test")
    )


def in_sample_dates(folds: DataFrame, tail_rows: int = 20, least_rows: int = 8) -> DataFrame:
    """Train rows of each path with ``is_tail``: the last max(2, min(``tail_rows``, n / 2)) of them;
    paths with fewer than ``least_rows`` train rows have no in-sample statistic and are left out."""
    train = folds.filter(~F.col("is_test")).select("path", "ts")
    n = train.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_rows)
    placed = with_positions(train, ["path"]).join(n, "path")
    tail = F.greatest(F.lit(2), F.least(F.lit(tail_rows), F.floor(F.col("_n") / 2).cast("int")))
    return placed.select("path", "ts", (F.col("pos") >= F.col("_n") - tail).alias("is_tail"))


def cpcv_summary(paths: DataFrame, sharpe: str = "oos_sharpe") -> DataFrame:
    """Mean, deviation (zero for a single path) and median of the finite out-of-sample Sharpes."""
    x = F.col(sharpe)
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return paths.agg(
        F.avg(finite).alias("oos_sharpe_mean"),
        F.when(F.count(finite) > 1, F.stddev_samp(finite)).when(F.count(finite) == 1, F.lit(0.0)).alias("oos_sharpe_std"),
        F.median(finite).alias("oos_sharpe_median"), F.count(F.lit(1)).alias("n_paths"),
    )


def pbo_rank_logit(paths: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Share of paths whose in-sample rank beats their out-of-sample rank on the logit scale; one
    half when fewer than two paths have both Sharpes. Sharpes equal to ``TIE_DECIMALS`` are tied."""
    keys = scope or ["_all"]
    both = paths if scope else paths.withColumn("_all", F.lit(1))
    finite = both.filter("is_sharpe is not null and oos_sharpe is not null and abs(is_sharpe) < double('inf') and abs(oos_sharpe) < double('inf')")
    finite = finite.withColumns({c: F.round(c, TIE_DECIMALS) for c in ("is_sharpe", "oos_sharpe")})
    ranked = rank_within(rank_within(finite, keys, "is_sharpe", "_ri"), keys, "oos_sharpe", "_ro")
    sized = ranked.join(finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)

    def p(rank):
        return F.least(F.greatest((F.col(rank) - 0.5) / F.col("_n"), F.lit(1e-9)), F.lit(1.0 - 1e-9))

    share = F.avg(F.when(logit(p("_ri")) - logit(p("_ro")) > 0, 1.0).otherwise(0.0))
    scored = sized.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, share).alias("_pbo"))
    out = both.select(*keys).distinct().join(scored, keys, "left").withColumn("pbo", F.coalesce("_pbo", F.lit(0.5)))
    return out.select(*(scope or []), "pbo")
