"""Raw documents to packed training sequences: quality rules, fuzzy line dedup, near-duplicates,
mixing, packing. Each stage works on all rows its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isochrone.llm import line_dedup, mixing, near_documents, packing, quality_rules
from isochrone.llm.common import stored, table
from isochrone.llm.queries import TOKENIZER, ship_package


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier line, has already."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash links, then MinHash for what fingerprints miss, verified
    at a similarity of 0.8 or more on runs of five words."""
    ship_package(spark)
    return near_documents.unique_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned out to the target of their source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("simhash_near_duplicates", near_duplicates),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: SQL can't express line dedup, near-duplicates, tokens and packing; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
