"""Distributed union-find: connected components by alternating large-star and small-star steps.

Edges stay in tables. A large-star step links every node's larger neighbours to the smallest node it
sees, a small-star step does the same for its smaller neighbours; each step is an aggregation of minima
(combined before the shuffle, so a hub costs one row per task) and one equi-join that Spark may split.
Once nothing changes every node points at the smallest node of its component. The number of rounds grows
with the logarithm of the component size; every round is written to the shared folder, and the round
before it is deleted once the next is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", into: list[str] | None = None) -> DataFrame:
    """(node, component) of every node of an undirected edge table, ``component`` its smallest node.
    ``into`` notes the folder of the last round.

    Self loops, repeated edges and NULL ends are ignored; nodes without any edge are not returned.
    """
    folders: list[str] = []
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct(), "components", folders)
    mark = _mark(now)
    while mark[0]:
        now = stored(_small_star(_large_star(now)), "components", folders)
        was, mark = mark, _mark(now)
        discard(edges.sparkSession, [folders.pop(0)])
        if was == mark:
            break
    if into is not None:
        into.extend(folders)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: two equal marks mean nothing changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
