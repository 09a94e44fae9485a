"""I-Match fingerprints: hashes of the terms inside a band of document frequencies.

1. ``lexicon``: the terms (words as written) found in at least ``LOW`` and at most ``HIGH`` of all
   documents. Counted over all whole texts, combined map-side. A document has finitely many distinct
   terms, so at most (mean number of distinct terms) / ``LOW`` terms can be that frequent: the lexicon has a
   bound that does not grow with the corpus, and is broadcast.
2. A text keeps its distinct lexicon terms, sorted. The full lexicon and randomised subsets of it, in
   rates from 1/2 downwards, give one hash each of the terms that remain. A subset from which nothing
   remains gives 0.
3. The likeness of two fingerprints is the share of equal hashes among the subsets from which something
   remains on either side; equal fingerprints have likeness 1.

Texts meet the lexicon inside their task; only the kept terms (64-bit hashes) are grouped per row.

4. A text with words, none of them in the lexicon, has nothing to compare: its fingerprint is a marked hash
   of the whole text, so it agrees with equal texts only.

Defined results: NULL text is empty; texts without a word share the fingerprint of nothing; rows without
``doc_id`` come last in the order; rows with equal ``doc_id`` are ordered by their text, so repeated
rows follow each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, require, split_words, stored, text_of

LOW, HIGH = 0.001, 0.2
#: Randomised lexicons: how many for each power of two by which they are thinned out.
SUBSETS = tuple(level for level in range(2, 10) for _ in range(6))
SEED = 1009
#: Documents that one task orders at most, on average, up to ``MOST_BLOCKS`` blocks.
BLOCK_ROWS = 4096
MOST_BLOCKS = 1024


def _terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    return F.array_distinct(F.transform(split_words(text), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term (hash), n_docs of the terms in the band."""
    require(docs, "text")
    total = docs.count()
    found = docs.select(F.explode(_terms(text_of())).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs"))
    return found.where((F.col("n_docs") >= low * total) & (F.col("n_docs") <= high * total))


def _thinned(i: int, level: int):
    """Membership in the ``i``-th randomised lexicon, which keeps one term in 2 ** level."""
    return lambda t: F.xxhash64(t, F.lit(SEED + i)).bitwiseAND(F.lit((1 << level) - 1)) == 0


def _hash(terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(F.lit(0).cast("long"))


def hashes_of(terms: Column) -> Column:
    """One hash for the full lexicon and one per subset, from the sorted distinct terms in the lexicon."""
    return F.array(_hash(terms), *[_hash(F.filter(terms, _thinned(i, level))) for i, level in enumerate(SUBSETS)])


def fingerprints(texts: DataFrame, kept: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """For rows with a unique ``key``: per text column the hashes, named like it with ``_hashes``.

    Rows without any kept term in any of the texts are left out; a text without any has hashes of 0.
    """
    each = F.array(*[F.struct(F.lit(i).alias("kind"), _terms(F.col(c)).alias("terms")) for i, c in enumerate(columns)])
    exploded = texts.select(*key, F.explode(each).alias("t")).select(*key, "t.kind", F.explode("t.terms").alias("term"))
    inside = exploded.join(F.broadcast(kept.select("term")), "term")
    # the terms of a row come from one task, which gathers them before anything is shuffled
    gathered = inside.groupBy(*key).agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == i, F.col("term")))).alias(f"terms_{i}") for i in range(len(columns))])
    return gathered.select(*key, *[hashes_of(F.col(f"terms_{i}")).alias(f"{c}_hashes") for i, c in enumerate(columns)])


def outside_hash(text: Column) -> Column:
    """What stands for a text none of whose words are in the lexicon; 0 for a text without words."""
    return F.when(F.btrim(text, F.lit(SPACE_CHARS)) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(text, F.lit("outside")))


def outside_hashes(outside: Column) -> Column:
    return F.array(outside, *[F.lit(0).cast("long")] * len(SUBSETS))


def printed(hashes: Column) -> Column:
    """A fingerprint as text: 64 hex digits, a digest of all hashes."""
    return F.sha2(F.array_join(F.transform(hashes, lambda h: h.cast("string")), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None).cast("int")).otherwise((x == y).cast("int")))
    held = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(a == b, F.lit(1.0)).otherwise(F.aggregate(held, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(held), F.lit(1)))


def with_next(docs: DataFrame) -> DataFrame:
    """block, place, doc_id, text, next_text: of the next document by descending ``doc_id``, after the
    last the first.

    Ids are cut into blocks at quantiles; windows run inside blocks, and only the first text of each
    block is looked at to join one block to the next. Texts are shuffled once and not written.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    total = docs.count()
    blocks = min(MOST_BLOCKS, -(-total // BLOCK_ROWS))
    cuts = []
    if blocks > 1:
        ids = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 100_000).alias("q")).first()["q"]
        cuts = sorted(set(ids or []))
    where = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("text")]
    inside = Window.partitionBy("block").orderBy(*order)
    rows = rows.withColumn("block", where.cast("int"))
    # one text per block: the first of the block after each, for the last the first
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("down"), "text_hash", "text"))
    firsts = rows.groupBy("block").agg(first.alias("first")).select(F.col("block").alias("first_block"), F.col("first.text").alias("first_text"))
    around = Window.orderBy(F.col("first_block").desc())
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = stored(firsts.select(F.col("first_block").alias("block"), F.coalesce(F.lead("first_text").over(around), F.first("first_text").over(every)).alias("block_next")), "imatch-firsts")
    marked = rows.withColumns({"next_text": F.lead("text").over(inside), "place": F.row_number().over(inside)})
    # both sides are partitioned by block; whole texts have no size bound, so no broadcast is asked for
    return marked.join(following, "block").select("block", "place", "doc_id", "text", F.coalesce("next_text", "block_next").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many, or all, of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, hashes, edited_hashes, next_hashes of every document."""
    require(docs, "doc_id", "text")
    kept = stored(lexicon(docs), "imatch-lexicon")
    rows = with_next(docs)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    prints = fingerprints(rows, kept, ["block", "place"], ["text", "edited"])
    facts = rows.select("block", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), outside_hash(F.col("text")).alias("text_outside"), outside_hash(F.col("edited")).alias("edited_outside"))
    whole = facts.join(prints, ["block", "place"], "left")
    hashes = {c: F.when(F.element_at(f"{c}_hashes", 1) != 0, F.col(f"{c}_hashes")).otherwise(outside_hashes(F.col(f"{c}_outside"))) for c in ("text", "edited")}
    whole = whole.select("block", "place", "doc_id", "n_chars", "edited_sha256", hashes["text"].alias("hashes"), hashes["edited"].alias("edited_hashes"))
    whole = stored(whole, "imatch-prints")
    inside = Window.partitionBy("block").orderBy("place")
    ahead = whole.withColumn("next_hashes", F.lead("hashes").over(inside))
    firsts = whole.where("place = 1").select("block", F.col("hashes").alias("first_hashes"))
    around = Window.orderBy(F.col("block").desc())
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("block", F.coalesce(F.lead("first_hashes").over(around), F.first("first_hashes").over(every)).alias("block_next"))
    return ahead.join(F.broadcast(following), "block").select("doc_id", "n_chars", "edited_sha256", "hashes", "edited_hashes", F.coalesce("next_hashes", "block_next").alias("next_hashes"))
