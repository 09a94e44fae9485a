"""Pairs of similar sets inside buckets, without forming all pairs of a bucket.

Two sets of Jaccard similarity ``t`` have sizes within a factor ``t``, and in any common order of elements
share one of their first ``n - ceil(t * n) + 1``. Elements are ordered rare first, counted over the sets asked
for, so unlike sets that agree in common elements only are never paired. Both conditions are exact: no
similar pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Guards products of sizes and the threshold against rounding.
SLACK = 1e-9


def sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - SLACK


def similar(common: Column, a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with ``common`` elements in both are similar enough."""
    return common >= similarity * (a + b - common) - SLACK


def open_members(members: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (bucket keys, node, n) with their component, of buckets that still have several components;
    ``groups`` is (node, component) of the nodes that have links. A bucket with one component hides no link."""
    rows = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = rows.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(*keys)
    return rows.join(buckets, keys, "left_semi")


def pairs_across(members: DataFrame, sets: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Distinct (a, b), a > b, of nodes that share a bucket, are in different components and may be similar.

    ``members``: bucket keys, node, component; ``sets``: node, elements (distinct), a stored table.
    """
    own = sets.join(members.select("node").distinct(), "node", "left_semi")
    elements = own.select("node", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    counted = elements.groupBy("element").agg(F.count("*").alias("often"))
    order = Window.partitionBy("node").orderBy("often", "element")
    first = elements.join(counted, "element").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - SLACK) + 1)
    return pairs_sharing(members, first.where("often > 1").select("node", "n", "element"), keys, similarity)


def main_marked(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (bucket keys, node, component) with ``main``, whether they are in their bucket's largest component."""
    counts = members.groupBy(*keys, "component").agg(F.count("*").alias("members"))
    largest = counts.groupBy(*keys).agg(F.max(F.struct("members", "component"))["component"].alias("largest"))
    return members.join(largest, keys).withColumn("main", F.col("component") == F.col("largest")).drop("largest")


def across_components() -> Column:
    """Whether (x, y), x not in its bucket's largest component, are of two components; each pair holds in one order."""
    return (F.col("component_x") != F.col("component_y")) & (F.col("main_y") | (F.col("component_x") < F.col("component_y")))


def pairs_sharing(members: DataFrame, first: DataFrame, keys: list[str], similarity: float, also: Column | None = None) -> DataFrame:
    """``pairs_across`` from the first elements of the sets in a common order: ``first`` is node, n, element. ``also`` is a
    condition on the columns of ``members``, which end in ``_x`` and ``_y``. A component that fills a bucket costs no pairs."""
    placed = main_marked(members, keys).join(first, "node")
    one, two = (placed.select(*keys, "element", *[F.col(c).alias(f"{c}_{side}") for c in [*members.columns, "main", "n"] if c not in keys]) for side in "xy")
    both = one.where("NOT main_x").join(two, [*keys, "element"]).where(across_components() & sizes_allow(F.col("n_x"), F.col("n_y"), similarity))
    both = both if also is None else both.where(also)
    return both.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
