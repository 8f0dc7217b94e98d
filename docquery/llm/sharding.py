"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded key and ranked within their source; a row's fractional
rank says how far into its source it stands. Sorted by that, every stretch of the
order holds the sources in the proportions of the whole, so cutting it at equal row
counts gives shards that match the mixture.

Ranks come from two-level running totals (``common.running_total``): no window spans
a source or the whole table, so a source with a third of the rows is sorted in
thousands of range buckets. Only keys and numbers are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import BUCKETS, cut, documents, key_bucket, running_total, shuffle_key

QUERY = "op3_shards"
SHARDS, SEED = 24, "shards-1"


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id, source, text).

    Law ``rows``: shard sizes differ by one row at most, whatever the texts' sizes.
    Copies of a text are rows like any other and spread as the key falls. Null
    sources are one source, null texts have no bytes, null ids are shuffled by their
    text; rows equal in id, source and text are interchangeable, so ties leave the
    result the same. An empty table gives no rows. Other columns are not read.
    Returns doc_id, source, size, text_crc32, law, shard, slot, grown_shard, where
    slot counts from 0 in the shard, without gaps.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    rows = cut(
        docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), shuffle_key(seed, F.col("doc_id"), F.col("source")).alias("key")).withColumn("bucket", key_bucket(F.col("key")))
    )
    order = ["key", "doc_id", "text_crc32", "size"]
    ranked = running_total(rows, ["source"], "bucket", order, F.lit(1), "rank")
    sources = rows.groupBy("source").agg(F.count("*").alias("in_source")).withColumnRenamed("source", "__source")
    ranked = ranked.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "bucket")
    at = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("in_source")).cast("double"))
    at = at.withColumn("stretch", F.floor(F.col("fraction") * BUCKETS).cast("int"))
    at = running_total(at, [], "stretch", ["fraction", *order, "source"], F.lit(1), "position")
    # a one-row side: the number of rows
    total = rows.agg(F.count("*").alias("total"))
    at = at.join(F.broadcast(total))
    shard = F.expr(f"position * {shards} div total")
    return at.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without text_crc32 SQL could express it; DuckDB has no crc32, so the test holds it against a brute-force version."""
    return interleave(documents(spark, sf_dir, "doc_id", "source", "text"))


ORACLE_SQL = None
