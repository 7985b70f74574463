"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns each row's shard and slot.

Defined results: documents without text or of empty text fail the quality rules; a null language or source is one of its own; rows
without doc_id are judged like others, and of near duplicates a row with an id stays before one without; rows of one id are told
apart by their texts; repeated rows are near duplicates, of which one stays, until the mixing stage repeats documents; ties are
broken by doc_id, then by the text's hash; very long texts are taken whole; other columns than the five of documents pass
through the first four stages, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.llm.common import Scratch, table
from starloom.llm.decontam import decontaminated
from starloom.llm.mixing import mixed_documents
from starloom.llm.neardup import deduplicated
from starloom.llm.quality import quality_filter
from starloom.llm.sharding import shard_documents

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row."""
    return shard_documents(docs, SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

#: The Hilbert order and the seeded selection have no SQL form; tests hold the first three stages against a brute-force version, and the
#: mixing and the sharding of their result against the laws that these must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
