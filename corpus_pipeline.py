"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

Every stage works on all rows that it gets, texts of any length included, and keeps their columns, whatever else they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language, near_duplicates, packing, secrets, substrings
from quarry.llm.common import aside, documents, small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the evidence settles.

    Null and empty texts, and those with hardly a letter, go; repeated rows are judged each; an empty table stays empty.
    """
    small_batches(spark)
    return language.identify(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least doc_id.

    Rows without words or without doc_id stay; rows that repeat the kept document's id and text stay too.
    """
    return near_duplicates.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a lower id holds; no row goes, and texts without passages, null ones too, are unchanged."""
    return substrings.remove(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; no row goes, and null texts stay null."""
    plain, own = aside(docs, ["spans"])
    masked = secrets.mask(secrets.find(plain, secrets.train(docs))).withColumn("n_chars", F.char_length("text").cast("long"))
    return masked.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed windows; a null or empty text is its end id alone, and a row is packed by itself."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language_id), ("near-duplicates", near_dedup), ("substring dedup", substring_dedup), ("secret scan", secret_scan), ("packing", pack)]

#: Models and hashes decide in these stages, which SQL can't express; tests check them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's result is stored before the next reads it."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
