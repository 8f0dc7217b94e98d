"""A training corpus from raw documents: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's ``docs``. All but the last return the columns
of ``documents``; the last adds the tokens.

A null or empty text has too few words and goes in the first stage; very long texts are
read whole by each stage; repeated rows are one document from the second stage on; null
ids and sources pass (the smallest id stays of a group, a null one only where there is
no other; null is a source of its own); other columns pass through, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquery.llm import bpe, mixing, pii, quality, simhash
from docquery.sources.storage import scratch

#: Not expressible in SQL: components, trees and tokens. The test holds the stages against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines go from the others."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: shingles of five words, a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the queue; a document comes as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, digests=True).drop("decoded")


STAGES = [("quality rules", quality_rules), ("near-dedup by shingle similarity", near_duplicates), ("pii redaction", personal_data), ("source mixture", mixture), ("bpe tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
