"""Mixing sources to target weights: a repetition rate per source, a number of copies per document.

Sources get weights, share a token budget by them, and none may go beyond ``cap`` times its own size;
what a capped source leaves is shared by weight among the rest. A document is then taken
``floor(rate)`` times, plus once more with the probability of the fraction, decided by a hash of seed
and ``doc_id``: no shuffle of documents, the same answer on every run and for any partitioning.

The source table has one row per source. The shares are solved by one window over it: with the rate
per unit of weight ``x``, a source is capped when ``cap * size / weight <= x``, so the capped ones are
a prefix in that order. Joining it back is a plain equi-join that Spark broadcasts while it is small
and otherwise splits, hot source included.

Defined results: NULL text has size 0; a NULL source is a source of its own, the last; sources without
any words have target 0; repeated rows are decided alike (same ``doc_id``, same draw); a NULL ``doc_id``
is drawn as the empty string; an empty table gives an empty mix; other columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, count_words, require, text_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
SEED = 20240


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, size) of all sources -> source, source_size, target, rate.

    ``weights`` repeat along the sources in order of code point, NULL last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.select("source", F.col("size").alias("source_size"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")).alias("weight"))
    # capped sources come first in this order; the rate per weight if exactly the first k - 1 are capped
    # is (budget - their caps) / (weight of the others), and the first source below its cap ends the prefix
    full = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = weighted.select(
        "*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("source_size").over(every).alias("size_all"), F.sum("weight").over(every).alias("weight_all"),
    ).withColumn("per_weight", (budget * F.col("size_all") - cap * F.col("size_before")) / (F.col("weight_all") - F.col("weight_before")))
    rows = rows.withColumn("level", F.min(F.when(F.col("per_weight") * F.col("weight") < cap * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "per_weight"))).over(every)["per_weight"])
    target = F.when(F.col("level").isNull(), cap * F.col("source_size")).otherwise(F.least(F.col("level") * F.col("weight"), cap * F.col("source_size")))
    rows = rows.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", F.least(rate, F.lit(float(cap))).alias("rate"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on seed and id only (32 bits of a digest)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document, and the document as ``row``."""
    require(docs, "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", count_words(text_of()).alias("size"), carried(docs))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(sizes, weights, budget, cap).select(F.col("source").alias("of_source"), "source_size", "target", "rate")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["of_source"]))
    whole = F.floor("rate")
    copies = whole + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), "row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Every document as many times as it is taken, columns as they were."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
