"""Structured Streaming twins of batch operators; each gives what its batch form gives on the same rows in order.

``live_cache`` and ``live_memory`` keep state by key with ``transformWithState``, which
needs RocksDB as the session's state store: ``docquery.sources.storage.state_session``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docquery.config import DEFAULTS
from docquery.operators import chunking, packing, tables
from docquery.sources import office

#: Rows of a key that are sorted at once.
_RUN = 65_536


def ingest(files: DataFrame, store: str, checkpoint: str, to_chunks: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """New files (document_id, text, …) to chunks, appended to ``store`` batch by batch; a batch that is run again replaces its own part."""
    make = to_chunks or (lambda df: df.select("document_id", F.posexplode(chunking.sentence_chunks(F.col("text"))).alias("chunk_index", "content")))

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The files below a folder, as they come."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)


def processed(elements: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.chunk_minimum, counter: Any = packing.by_characters) -> tuple[DataFrame, DataFrame]:
    """Elements of files (``office.elements``) to their chunks (document_id, chunk_type, chunk_index, content, section) and the outcome of each file (document_id, filename, status, chunks_count, tables_count, error)."""
    own = elements.withColumns({"block_idx": F.col("place"), "page_number": F.lit(None).cast("int")})
    blocks = chunking.with_sections(own.filter("type in ('heading', 'paragraph')"))
    text = packing.pack_blocks(blocks, size, overlap, least, counter=counter).select("document_id", F.lit("text").alias("chunk_type"), "chunk_index", "content", F.element_at(F.concat(F.col("sections"), F.array(F.lit(""))), 1).alias("section"))
    found = tables.section_tables(elements.drop("error"))
    table = tables.clean(found).select("document_id", F.lit("table").alias("chunk_type"), F.col("place").alias("chunk_index"), tables.row_text().alias("content"), "section")
    chunks = text.unionByName(table)
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("chunk_type") == "table").alias("tables"))
    files = elements.groupBy("document_id", "filename").agg(F.max("error").alias("error"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n") > 0, "completed").otherwise("warning")
    log = files.join(counted, "document_id", "left").select("document_id", "filename", status.alias("status"), F.coalesce("n", F.lit(0)).alias("chunks_count"), F.coalesce("tables", F.lit(0)).alias("tables_count"), "error")
    return chunks, log


def ingest_files(files: DataFrame, store: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """New files (path, content) to ``store``/chunks and ``store``/log, see ``processed``; a file that can't be parsed is a failed row of the log and the stream goes on.

    A batch's files are parsed once: their elements are written first, and both sinks
    read them. A batch that is run again replaces its own parts of all three.
    """

    def write(batch: DataFrame, number: int) -> None:
        parts = {name: f"{store}/{name}/batch={number}" for name in ("elements", "chunks", "log")}
        office.elements(batch).write.mode("overwrite").parquet(parts["elements"])
        chunks, log = processed(batch.sparkSession.read.schema(office.SCHEMA).parquet(parts["elements"]), **options)
        chunks.write.mode("overwrite").parquet(parts["chunks"])
        log.write.mode("overwrite").parquet(parts["log"])

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(log: DataFrame, window: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Requests by method, endpoint and status; with ``window`` also by that span of event time, late rows beyond the watermark dropped."""
    keys = ["method", "endpoint", "status"]
    if window is None:
        return log.groupBy(*keys).agg(F.count("*").alias("requests"))
    return log.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", watermark).groupBy(F.window("asked_at", window), *keys).agg(F.count("*").alias("requests"))


def _in_order(rows: Iterator[Row]) -> Iterator[tuple[int, int]]:
    """(at, event_id) of a key's rows in order: sorted runs of numbers, merged as they are read."""
    runs = []
    while part := [*islice(rows, _RUN)]:
        run = np.array([(r.at, r.event_id) for r in part], np.int64)
        runs.append(run[np.lexsort((run[:, 1], run[:, 0]))])
    return heapq.merge(*(((int(a), int(e)) for a, e in run) for run in runs))


class _CacheProcessor(StatefulProcessor):
    """State of a key: when its entry runs out; a timer of event time ends it."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.until.get()[0] if self.until.exists() else None
        until, seen = -1 if before is None else before, timerValues.getCurrentWatermarkInMs() * 1000
        for at, event_id in _in_order(rows):
            if at < seen:
                yield Row(event_id=event_id, key=key[0], hit=None)
                continue
            hit = at < until
            if not hit:
                until = at + self.ttl
            yield Row(event_id=event_id, key=key[0], hit=hit)
        if until >= 0 and until != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            self.until.update((until,))
            self.handle.registerTimer(until // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_cache(log: DataFrame, ttl_s: int = DEFAULTS.cache_ttl_s, delay: str = "1 day") -> DataFrame:
    """Hit or miss of each request (event_id, key, asked_at) as it comes.

    Rows more than ``delay`` of event time behind the latest of the batches before are
    late: they change nothing and have no ``hit``; ``late_rows`` counts them. The state
    of a key is when its entry runs out; when event time has passed that, it is removed,
    so state holds the keys of the last ``ttl_s`` and ``delay``, not all ever seen. Rows of a key and a
    batch are sorted as 16 bytes each; a trigger's size bounds them.
    """
    timed = log.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", delay).select("event_id", "key", "asked_at", F.unix_micros("asked_at").alias("at"))
    return timed.groupBy("key").transformWithState(_CacheProcessor(ttl_s * 1_000_000), "event_id long, key long, hit boolean", "append", "eventTime")


def late_rows(answered: DataFrame) -> DataFrame:
    """One row: requests answered by ``live_cache`` and those that came too late."""
    return answered.agg(F.count("hit").alias("answered"), F.count_if(F.col("hit").isNull()).alias("late"))


class _MemoryProcessor(StatefulProcessor):
    """State of a conversation: its last turns."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, role string, text string, ts timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # never more than ``most`` turns at a time, whatever a batch brings
        heap: list[tuple] = []
        n = 0
        for source in (self.kept.get(), ((r.turn, r.role, r.text, r.ts) for r in rows)):
            for turn, role, text, ts in source:
                item = ((turn is not None, turn or 0, role or "", text or "", n), (turn, role, text, ts))
                n += 1
                (heapq.heappush if len(heap) < self.most else heapq.heappushpop)(heap, item)
        turns = [t for _, t in sorted(heap)]
        self.kept.put(turns)
        for turn, role, text, ts in turns:
            yield Row(conv_id=key[0], turn=turn, role=role, text=text, ts=ts)

    def close(self) -> None:
        pass


def live_memory(turns: DataFrame, most: int = DEFAULTS.max_messages) -> DataFrame:
    """The last ``most`` turns of each conversation (conv_id, turn, role, text, ts), all of them anew for each conversation that a batch touches. Turns of one number go by role and text."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "ts").groupBy("conv_id").transformWithState(_MemoryProcessor(most), "conv_id long, turn long, role string, text string, ts timestamp", "update", "none")


def remembered(updates: DataFrame) -> DataFrame:
    """What is remembered after updates of ``live_memory`` (with ``batch``, their number): of each conversation the last. ``conversation.evicted`` leaves those updated last."""
    last = Window.partitionBy("conv_id")
    return updates.withColumn("__last", F.max("batch").over(last)).filter("batch = __last").drop("__last", "batch")
