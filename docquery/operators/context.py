"""Cited contexts, source lists and prompts from ranked chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.config import DEFAULTS


def contexts(hits: DataFrame, *, short: bool = False) -> DataFrame:
    """One context a query (query_id, context) from ranked chunks with filename, page_number, chunk_type, content and, if there, department, category, version and doc_date. A missing page is N/A. ``short``: the file name alone."""
    if short:
        head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("filename", F.lit("Unknown")), F.lit("]"))
    else:
        note = lambda c, name: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
        notes = [note(c, n) for c, n in (("department", "Dept"), ("category", "Category"), ("version", "Version"), ("doc_date", "Date")) if c in hits.columns]
        where = F.concat(F.lit("Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("N/A")), F.when(F.col("chunk_type").isin("table", "table_rows"), ", Type: Table").otherwise(""))
        head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("filename", F.lit("Unknown")), F.lit(", "), F.concat_ws(" | ", where, *notes), F.lit("]"))
    part = F.concat(head, F.lit("\n"), F.col("content"), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"])
    return hits.groupBy("query_id").agg(F.array_join(parts, "\n---\n").alias("context"))


def sources(hits: DataFrame, chars: int = DEFAULTS.excerpt_chars) -> DataFrame:
    """The list of sources of an answer: excerpt, names, page, type and score."""
    return hits.select("query_id", "rank", F.substring("content", 1, chars).alias("content"), "document_id", F.col("filename").alias("document_name"), "page_number", F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"), F.col("score").alias("relevance_score"))
