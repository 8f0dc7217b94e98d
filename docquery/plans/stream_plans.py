"""Registered queries of the streaming twins: each reads its table as a stream of files, runs to its end, and gives what its batch twin gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators import conversation
from docquery.plans import memory_plans, text_plans
from docquery.sources import fixtures as fx
from docquery.sources.storage import scratch, state_session
from docquery.streaming import jobs


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # as a pattern, since a stream takes a single file in no other form; it fits a folder as well
    return spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).parquet(f"{sf}/{name}.parque[t]")


def _written(df: DataFrame, mode: str, name: str) -> DataFrame:
    """The rows that a stream has written to the shared folder when its input is at an end; with each batch's number, as updates come again."""
    path, spark = scratch(df.sparkSession, name), df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, batch int").parquet(f"{path}/out/*")


def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """New documents to chunks, as they come."""
    path = scratch(spark, "ingest")
    files = _stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    jobs.ingest(files, f"{path}/store", f"{path}/state", lambda df: df.select("document_id", F.posexplode(text_plans.chunking.sentence_chunks(F.col("text"), 120, 25)).alias("chunk_index", "content"))).awaitTermination()
    return spark.read.parquet(f"{path}/store").select("document_id", "chunk_index", "content")


def counted(spark: SparkSession, sf: str) -> DataFrame:
    """Live counters: the last update of each counts."""
    out = _written(jobs.live_counts(fx.requests_of(_stream(spark, sf, "events"))), "update", "counts")
    return out.groupBy("method", "endpoint", "status").agg(F.max_by("requests", "batch").alias("requests"))


def cached(spark: SparkSession, sf: str) -> DataFrame:
    """With a delay beyond the table's span, so that no request counts as late however its files lie."""
    return _written(jobs.live_cache(fx.requests_of(_stream(state_session(spark), sf, "events")), memory_plans.TTL, "3650 days"), "append", "hits").select("event_id", "key", "hit")


def _memory(spark: SparkSession, sf: str, most: int) -> DataFrame:
    turns = fx.conversations_of(_stream(state_session(spark), sf, "conversations"))
    return jobs.remembered(_written(jobs.live_memory(turns, most), "update", "memory"))


def remembered(spark: SparkSession, sf: str) -> DataFrame:
    return _memory(spark, sf, 4).select("conv_id", "turn", "role", "text")


def remembered_recently(spark: SparkSession, sf: str) -> DataFrame:
    """The memory without the conversations that were not updated of late."""
    return conversation.evicted(_memory(spark, sf, 4), 25).select("conv_id", "turn")


def ingested_files(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's items as files of two formats, one of which has no parser, streamed from their folder: the outcome of each."""
    path = scratch(spark, "ingest-files")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.concat(F.lit("# Item\n\n"), "text", F.lit("\n\n"), "text").alias("text"))
    for kind, which in (("text", "item_id % 4 < 3"), ("csv", "item_id % 4 = 3")):
        items.filter(which).withColumnRenamed("item_id", "item").write.partitionBy("item").format(kind).save(f"{path}/in/{kind}")
    jobs.ingest_files(jobs.file_stream(spark, f"{path}/in/*/item=*"), f"{path}/store", f"{path}/state", size=40, overlap=10, least=5).awaitTermination()
    return spark.read.parquet(f"{path}/store/log").select("status", "error", "tables_count").groupBy("status", "error", "tables_count").agg(F.count("*").alias("files"))


QUERIES = {"r1_ingest": ingested, "r2_live_counts": counted, "r3_live_cache": cached, "r4_live_memory": remembered, "r4_live_evicted": remembered_recently, "r1_ingest_files": ingested_files}

#: r1_ingest has none, as packing by sentences (a step a sentence) is too slow in SQL on whole tables; its tests hold it against plain Python.
SQL = {
    "r2_live_counts": memory_plans.SQL["g1_request_counts"],
    "r3_live_cache": memory_plans.SQL["c2_cache_replay"],
    "r4_live_memory": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4",
    "r4_live_evicted": f"WITH {fx.QUESTIONS_SQL} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conv) WHERE back <= 4 AND conv_id IN (SELECT conv_id FROM conv GROUP BY conv_id ORDER BY max(ts) DESC, conv_id LIMIT 25)",
    "r1_ingest_files": "SELECT CASE WHEN item_id % 4 = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN item_id % 4 = 3 THEN 'ValueError: Unsupported file format: .csv' END AS error, CAST(0 AS BIGINT) AS tables_count, count(*) AS files FROM benchmark GROUP BY ALL",
}
