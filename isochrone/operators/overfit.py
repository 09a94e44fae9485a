"""Corrections for selection among many configurations. Input: long ``(ts, config, ret)``."""

from __future__ import annotations

import itertools
import math
import random
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import missing_if_not_finite, normal_cdf, ratio
from ..functions.spark import materialise
from .cross import median_within
from .folds import indexed_calendar
from .panel import benchmark_align
from .series import running

# Constants of the expected maximum Sharpe.
EULER_GAMMA = 0.5772
EULER_E = 2.718
PROBABILITY_FLOOR = 1e-12
HASH_DIGITS = 8
#: Combinations that one row expands to.
COMBINATION_BLOCK = 512


def sample_moments(returns: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Count, Sharpe per period, skewness and (normal = 3) kurtosis."""
    x = F.col(ret)
    return returns.groupBy(*keys).agg(
        F.count(x).alias("n_obs"), ratio(F.avg(x), F.stddev_samp(x)).alias("sharpe"),
        F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"),
    )


def expected_max_sharpe(n_trials: int) -> float:
    """Expected best Sharpe of ``n_trials`` worthless trials (zero for one)."""
    if n_trials <= 0:
        raise ValueError(f"{n_trials} trials: at least one is needed")
    if n_trials == 1:
        return 0.0

    def quantile(p):
        return NormalDist().inv_cdf(min(max(p, PROBABILITY_FLOOR), 1.0 - PROBABILITY_FLOOR))

    return (1.0 - EULER_GAMMA) * quantile(1.0 - 1.0 / n_trials) + EULER_GAMMA * quantile(1.0 - 1.0 / (n_trials * EULER_E))


def deflated_sharpe_col(sharpe: Column, n_trials: int, n_obs: Column, skew: Column, kurt: Column) -> Column:
    star = expected_max_sharpe(n_trials)
    var = ratio(F.lit(1.0) - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, n_obs - 1)
    return F.when(var > 0, normal_cdf((sharpe - star) / F.sqrt(var)))


def deflated_sharpe(returns: DataFrame, n_trials: int | None = None, ret: str = "ret") -> DataFrame:
    """Deflated Sharpe ratio per configuration; trials default to the number of configurations."""
    n = n_trials or returns.select("config").distinct().count()
    m = sample_moments(returns, ["config"], ret)
    dsr = deflated_sharpe_col(F.col("sharpe"), n, F.col("n_obs"), F.col("skew"), F.col("kurt"))
    return m.withColumn("dsr", dsr)


def _halves(n_chunks: int) -> int:
    if n_chunks < 2 or n_chunks % 2:
        raise ValueError(f"{n_chunks} chunks cannot be halved: an even number from 2 on is needed")
    return n_chunks // 2


def cscv_combinations(n_chunks: int, limit: int | None = None, seed: int = 0) -> list[tuple[int, ...]]:
    """Training-chunk combinations in lexicographic order: all of them, or a seeded sample of ``limit``
    when the caller asks for one. Depends on the settings only; ``chosen_combinations`` says which."""
    every = itertools.combinations(range(n_chunks), _halves(n_chunks))
    chosen = chosen_combinations(n_chunks, limit, seed)
    if isinstance(chosen, int):
        return list(every)
    wanted = set(chosen)
    return [c for i, c in enumerate(every) if i in wanted]


def chosen_combinations(n_chunks: int, limit: int | None = None, seed: int = 0) -> int | list[int]:
    """The number of combinations when all are evaluated, else the sorted ranks of the seeded sample."""
    total = math.comb(n_chunks, _halves(n_chunks))
    if limit is None or total <= limit:
        return total
    return sorted(random.Random(seed).sample(range(total), limit))


def mask_of_rank(rank: Column, n_chunks: int) -> Column:
    """Bit mask (the first chunk is the highest bit) of the combination with this lexicographic rank.

    Combinations that hold the next chunk come first, and there are binomially many of them: a smaller
    rank takes the chunk, a larger one is lowered by their number and passes it over.
    """
    half = _halves(n_chunks)
    table = F.array(*[F.array(*[F.lit(math.comb(n_chunks - 1 - c, k - 1) if k else 0).cast("long") for k in range(half + 1)]) for c in range(n_chunks)])

    def pass_chunk(state, chunk):
        holding = F.element_at(F.element_at(table, chunk + 1), state["left"] + 1)
        taken = state["rank"] < holding
        return F.struct(
            F.when(taken, state["rank"]).otherwise(state["rank"] - holding).alias("rank"),
            (state["left"] - taken.cast("int")).alias("left"), (state["mask"] * 2 + taken.cast("int")).alias("mask"),
        )

    start = F.struct(rank.cast("long").alias("rank"), F.lit(half).alias("left"), F.lit(0).cast("long").alias("mask"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n_chunks - 1)), start, pass_chunk, lambda s: s["mask"])


def complete_rows(returns: DataFrame) -> DataFrame:
    """Rows of the dates on which every configuration has a finite return."""
    clean = returns.withColumn("ret", missing_if_not_finite(F.col("ret")))
    n = clean.agg(F.count_distinct("config")).scalar()
    full = clean.groupBy("ts").agg(F.count("ret").alias("_n")).filter(F.col("_n") == n).select("ts")
    return clean.join(full, "ts", "left_semi")


def chunk_moments(returns: DataFrame, n_chunks: int) -> DataFrame:
    """One row per configuration: ``chunks``, an array of (n, sum, sum of squares) per equal time chunk
    around the configuration's mean ``m``; the tail that does not fill a chunk is trimmed.

    The returns are reduced to one row per (configuration, chunk) in one pass; everything after works on
    the arrays. Refuses fewer than two configurations or two rows per chunk.
    """
    _halves(n_chunks)
    complete = complete_rows(returns)
    calendar = materialise(indexed_calendar(complete), "calendar")
    rows = calendar.count()
    if rows < 2 * n_chunks:
        raise ValueError(f"{rows} complete dates do not give {n_chunks} chunks of two rows")
    chunks = calendar.select("ts", F.floor(F.col("pos") / (rows // n_chunks)).cast("int").alias("chunk")).filter(F.col("chunk") < n_chunks)
    local = complete.join(chunks, "ts").groupBy("config", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("_mean"), F.var_pop("ret").alias("_var")
    )
    whole = Window.partitionBy("config")
    centred = local.withColumn("m", F.sum(F.col("n") * F.col("_mean")).over(whole) / F.sum("n").over(whole))
    shift = F.col("_mean") - F.col("m")
    parts = centred.select(
        "config", F.struct("chunk", F.col("n").cast("double").alias("n"), (F.col("n") * shift).alias("s"), (F.col("n") * (F.col("_var") + shift * shift)).alias("q")).alias("part"), "m"
    )
    moments = materialise(parts.groupBy("config").agg(F.sort_array(F.collect_list("part")).alias("chunks"), F.first("m").alias("m")), "moments")
    if moments.limit(2).count() < 2:
        raise ValueError("one configuration alone cannot be overfitted: at least two are needed")
    return moments


def combination_sharpes(moments: DataFrame, n_chunks: int, limit: int | None = None) -> DataFrame:
    """In- and out-of-sample Sharpe of every configuration under every combination.

    Every configuration numbers its own combinations, in blocks, and finds their masks from the numbers: no table of combinations is made, sent or joined. The sums over chunks are plain arithmetic.
    """
    chosen = chosen_combinations(n_chunks, limit)
    total = chosen if isinstance(chosen, int) else len(chosen)
    tasks = int(moments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = moments.select("config", "m", *[F.get("chunks", F.lit(c))[v].alias(f"{v}{c}") for c in range(n_chunks) for v in ("n", "s", "q")])
    # a row per block of combinations is sent, and expands where it arrives
    blocks = flat.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // COMBINATION_BLOCK)))).repartition(tasks)
    first = F.col("block") * COMBINATION_BLOCK
    ranks = F.array(*[F.lit(i) for i in chosen]) if not isinstance(chosen, int) else None

    def with_mask(combo):
        rank = combo if ranks is None else F.element_at(ranks, combo + 1)
        return F.struct(combo.alias("combo"), mask_of_rank(rank, n_chunks).alias("mask"))

    # exploded with its mask, which is found once
    numbers = F.transform(F.sequence(first, F.least(first + COMBINATION_BLOCK, F.lit(total)) - 1), with_mask)
    masked = blocks.select("*", F.inline(numbers))

    def side(name, flag):
        held = [F.shiftright("mask", n_chunks - 1 - c).bitwiseAND(F.lit(1)) == flag for c in range(n_chunks)]
        sums = [sum((F.when(h, F.col(f"{v}{c}")).otherwise(0.0) for c, h in enumerate(held)), F.lit(0.0)).alias(v) for v in ("n", "s", "q")]
        return F.struct(*sums).alias(name)

    sides = masked.select("combo", "config", "m", side("is", 1), side("oos", 0))

    def sharpe(name):
        n, s, q = (F.col(f"{name}.{c}") for c in ("n", "s", "q"))
        var = (q - s * s / n) / (n - 1)
        value = ratio(F.col("m") + s / n, F.sqrt(F.greatest(var, F.lit(0.0)))) * F.lit(252.0**0.5)
        return F.coalesce(value, F.lit(float("-inf")))

    return sides.select("combo", "config", sharpe("is").alias("is_sharpe"), sharpe("oos").alias("oos_sharpe"))


def best_config(scores: DataFrame, by: list[str], score: str, config: str = "config") -> DataFrame:
    """Configuration with the highest score, the first one on ties."""
    first = F.min_by(F.struct(config, score), F.struct(-F.col(score), F.col(config))).alias("_best")
    known = scores.filter(F.col(score).isNotNull())
    found = known.groupBy(*by).agg(first) if by else known.agg(first)
    return found.select(*by, F.col(f"_best.{config}").alias("best_config"), F.col(f"_best.{score}").alias(score))


def cscv_paths(returns: DataFrame, n_chunks: int = 16, limit: int | None = None, bound: int | None = None) -> DataFrame:
    """Per combination: the in-sample winner, its out-of-sample Sharpe and the median of all."""
    moments = chunk_moments(returns, n_chunks)
    scores = materialise(combination_sharpes(moments, n_chunks, limit), "sharpes")
    bound = moments.count() if bound is None else bound  # a combination has one row per configuration
    winner = best_config(scores, ["combo"], "is_sharpe")
    chosen = winner.withColumnRenamed("best_config", "config").join(scores.select("combo", "config", "oos_sharpe"), ["combo", "config"])
    median = median_within(scores, ["combo"], "oos_sharpe", "config", "median_oos", bound)
    return chosen.join(median, "combo").select("combo", "config", "is_sharpe", "oos_sharpe", "median_oos")


def pbo_cscv(returns: DataFrame, n_chunks: int = 16, limit: int | None = None, bound: int | None = None) -> DataFrame:
    """Probability of backtest overfitting: share of combinations whose in-sample winner ends below
    the out-of-sample median."""
    paths = cscv_paths(returns, n_chunks, limit, bound)
    return paths.agg(
        F.avg(F.when(F.col("oos_sharpe") < F.col("median_oos"), 1.0).otherwise(0.0)).alias("pbo"), F.count(F.lit(1)).alias("n_trials")
    )


def _uniform(seed: int, salt: str, draw: Column, pos: Column) -> Column:
    """Uniform number in [0, 1) fixed by (seed, salt, draw, position)."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), draw.cast("string"), pos.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def stationary_bootstrap(positions: DataFrame, n_rows: Column, n_bootstrap: int, block_length: Column, seed: int = 0) -> DataFrame:
    """Resampled row indices ``(draw, pos, idx)``: restart at a uniform row with probability
    1 / block length, else the row after the previous one, circularly.

    Restarts come from hashes, so every draw can be recomputed on its own; between restarts the
    index is the last restart plus the distance from it.
    """
    draws = positions.select("pos").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))))
    restart = (F.col("pos") == 0) | (_uniform(seed, "restart", F.col("draw"), F.col("pos")) < F.lit(1.0) / block_length)
    row = F.floor(_uniform(seed, "row", F.col("draw"), F.col("pos")) * n_rows)
    marked = draws.withColumn("_start", F.when(restart, F.struct(row.alias("row"), F.col("pos").alias("at"))))
    # positions as seconds, so that a long series is carried forward in blocks
    timed = marked.withColumn("_at", F.timestamp_seconds("pos"))
    last = running(timed, ["draw"], {"_last": ("last", F.col("_start"))}, ts="_at", span="day")
    return last.select("draw", "pos", ((F.col("_last.row") + F.col("pos") - F.col("_last.at")) % n_rows).cast("int").alias("idx"))


def spa_differentials(benchmark: DataFrame, strategies: DataFrame) -> DataFrame:
    """``(ts, config, d)``: strategy minus benchmark on the dates complete for all."""
    aligned = benchmark_align(benchmark, strategies)
    return aligned.select("ts", "config", (F.col("ret") - F.col("bench")).alias("d"))


def spa_test(benchmark: DataFrame, strategies: DataFrame, n_bootstrap: int = 1000, significance: float = 0.05, seed: int = 0) -> DataFrame:
    """Superior predictive ability of the best strategy over the benchmark. Without any date common to
    all, statistic and p-value are NULL and nothing is rejected.

    A draw's mean is the differential weighted by how often each row was drawn, so the resampled
    indices are counted per row first and only those counts meet the strategies.
    """
    if n_bootstrap <= 0:
        raise ValueError(f"{n_bootstrap} draws: at least one is needed")
    if not 0.0 < significance < 1.0:
        raise ValueError(f"a significance of {significance} is not between 0 and 1")
    d = materialise(spa_differentials(benchmark, strategies), "differentials")
    calendar = materialise(indexed_calendar(d), "calendar")
    n = calendar.agg(F.count(F.lit(1))).scalar()
    block = F.greatest(F.lit(1), F.floor(F.pow(n, F.lit(0.25))))
    counts = stationary_bootstrap(calendar, n, n_bootstrap, block, seed).groupBy("draw", F.col("idx").alias("pos")).agg(F.count(F.lit(1)).alias("_k"))
    means = materialise(d.groupBy("config").agg(F.avg("d").alias("mean_d")), "means")
    centred = d.join(means, "config").join(calendar, "ts").select("config", "pos", (F.col("d") - F.col("mean_d")).alias("_d0"))
    drawn = counts.join(centred, "pos").groupBy("draw", "config").agg((F.sum(F.col("_k") * F.col("_d0")) / n).alias("_mean"))
    stats = drawn.groupBy("draw").agg(F.max("_mean").alias("stat"))
    observed = means.agg(F.max("mean_d")).scalar()
    best = best_config(means, [], "mean_d").select("best_config", F.col("mean_d").alias("statistic"))
    p = stats.agg(((F.lit(1.0) + F.count_if(F.col("stat") >= observed)) / F.lit(n_bootstrap + 1.0)).alias("p_value"))
    return best.withColumn("p_value", F.when(F.col("statistic").isNotNull(), p.scalar())).withColumn(
        "reject_null", F.coalesce((F.col("p_value") < significance) & (F.col("statistic") > 0), F.lit(False))
    )
