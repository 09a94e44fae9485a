"""Near-duplicate documents: Jaccard similarity of word shingles, candidates by SimHash, then MinHash.

Two documents are near-duplicates when the Jaccard similarity of their sets of ``SHINGLE`` consecutive
words is at least ``SIMILARITY``; letters A-Z are lowered and white space is collapsed before.

1. SimHash. Each text is hashed in its task to the fingerprint of ``simhash``; the vantage-point search links
   those at most two bits apart. Texts of equal words are one node from here on.
2. Verification of these links, exactly, on the full sets of shingles. Components follow.
3. MinHash for what fingerprints miss (at this similarity most differ in more bits than a tree over Hamming space
   can route; figures in the README): ``BANDS`` buckets of ``ROWS`` minima, each minimum under a multiplication of
   its own. A pair at the threshold shares no bucket with a probability of (1 - 0.8 ** 4) ** 20 = 0.003 %. Each
   member of a bucket that is not yet in the component of the bucket's smallest is compared with it: linear in
   the bucket.
4. Rest. Members of buckets that are still in different components are paired through their rarest shingles
   (``set_links``), which loses no pair and never forms all pairs of a bucket.
5. Of each component the row with the smallest (doc_id, text) stays.

Defined results: a NULL text is empty, and all texts without words are one group; a text of fewer words
than a shingle is one shingle; rows without ``doc_id`` come last in their group and are told apart by
their text; of repeated rows one stays; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, require, split_words, stored, text_of
from .components import connected_components
from .set_links import open_members, pairs_across, similar, sizes_allow
from .simhash import fingerprint_links, fingerprint_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
SEED = 42

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(SEED + 1).integers(0, 2**63, (BANDS, ROWS), dtype="uint64") * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words of a UTF-8 text, upper case A-Z lowered."""
    import xxhash

    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, "uint64")
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), "int64", n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), "uint64", n - width + 1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Numbers of the buckets of a text, one per band."""
    minima = np.full(BANDS * ROWS, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(hashes), 16_384):
        block = hashes[at : at + 16_384]
        for i, m in enumerate(_MULTIPLIERS):
            minima[i] = min(minima[i], (block * m).min())
    mixed = (minima.reshape(BANDS, ROWS) >> np.uint64(7)) * _MIX
    return np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(32)), axis=1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _buckets(texts: pd.Series) -> pd.Series:
    return pd.Series([signature(shingle_hashes(t.encode("utf-8", "surrogatepass"))).view("int64") for t in texts])


def _words(text: Column) -> Column:
    return split_words(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def node() -> Column:
    """16 bytes that name the words of a text."""
    return F.unhex(F.md5(F.array_join(_words(text_of()), " ")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of the distinct runs of ``SHINGLE`` words; a shorter text is one run, an empty one none."""
    return _bound(_words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE)))))))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose sets of shingles are similar enough; sets that
    differ too much in size are dropped before any set travels."""
    sizes = sets.select("node", F.size("elements").alias("n"))
    sized = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        sized = sized.join(sizes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")), side)
    sized = sized.where(sizes_allow(F.col("n_a"), F.col("n_b"), SIMILARITY)).select("a", "b")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    near = _bound(F.size(F.array_intersect("x", "y")), lambda c: similar(c, F.size("x"), F.size("y"), SIMILARITY))
    return sized.join(left, "a").join(right, "b").where(near).select("a", "b")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes ``(node, fp)`` that connect all whose fingerprints are linked: every node with
    the smallest of its fingerprint, and these over the links of the vantage-point search."""
    points = stored(prints.groupBy("fp").agg(F.min("node").alias("head")), "near-points")
    same = prints.join(points, "fp").where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    found = fingerprint_links(points)
    for fp, name in (("a", "x"), ("b", "y")):
        found = found.join(points.select(F.col("fp").alias(fp), F.col("head").alias(name)), fp)
    return same.union(found.select("x", "y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that (node, component) has not connected."""
    for side in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.where("c_a IS NULL OR c_b IS NULL OR c_a <> c_b").select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """(node, component) of the texts that have near-duplicates of other words."""
    hashed = stored(docs.select(node().alias("node"), fingerprint_of(text_of()).alias("fp"), _buckets(text_of()).alias("buckets")).dropDuplicates(["node"]), "near-hashes")
    close = stored(fingerprint_pairs(hashed.select("node", "fp")), "near-fingerprints")
    placed = hashed.select("node", F.posexplode("buckets").alias("band", "bucket"))
    heads = placed.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").drop("last")
    star = stored(placed.join(heads, ["band", "bucket"]), "near-star")
    members = star.select("node").union(close.select("a")).union(close.select("b")).distinct()
    texts = docs.select(node().alias("node"), text_of().alias("text")).join(members, "node", "left_semi").dropDuplicates(["node"])
    sets = stored(texts.select("node", shingles(F.col("text")).alias("elements")), "near-shingles")
    alike = stored(verified(close, sets), "near-alike")
    pairs = star.where("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    first = stored(apart(pairs, connected_components(alike)), "near-first")
    linked = stored(alike.union(verified(first, sets)), "near-links")
    rest = stored(open_members(star.select("band", "bucket", "node"), connected_components(linked), ["band", "bucket"]), "near-rest")
    untested = pairs_across(rest, sets, ["band", "bucket"], SIMILARITY).join(first, ["a", "b"], "left_anti")
    return connected_components(linked.union(verified(untested, sets)))


def unique_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest ``doc_id``."""
    require(docs, "doc_id", "text")
    groups = components(docs)
    spots = docs.select("doc_id", node().alias("node"), F.xxhash64(text_of()).alias("text_hash"))
    named = spots.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spot = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "node")
    first = named.groupBy("component").agg(F.min(spot).alias("first"))
    chosen = first.select("component", F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"), F.col("first.node").alias("keep_node"))
    own = docs.select(carried(docs), "doc_id", F.xxhash64(text_of()).alias("text_hash"), node().alias("node"))
    hit = own.join(chosen, own["doc_id"].eqNullSafe(chosen["keep_id"]) & (own["text_hash"] == chosen["keep_hash"]) & (own["node"] == chosen["keep_node"]))
    return hit.dropDuplicates(["component"]).select("row.*")
