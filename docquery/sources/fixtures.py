"""Inputs of the registered queries, derived by Spark from the given tables; the SQL beside each is the same derivation for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.sources.tables import table

#: Rows whose id is divisible by this are the queries of searches.
QUERY_EVERY = 50
START = "2024-01-01 00:00:00"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk store over ``embeddings``."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("vec_id"),
        F.expr("concat(vec_id div 5, '_', vec_id % 5)").alias("chunk_id"),
        F.expr("cast(vec_id div 5 as string)").alias("document_id"),
        F.expr("concat('file', vec_id div 5, '.txt')").alias("filename"),
        F.lit("txt").alias("file_type"),
        (v % 5 + 1).cast("int").alias("page_number"),
        F.concat(F.lit("D"), F.col("label")).alias("department"),
        F.array(F.concat(F.lit("t"), v % 3), F.concat(F.lit("u"), v % 4)).alias("tags"),
        F.when(v % 4 == 0, "table").otherwise("text").alias("chunk_type"),
        F.concat(F.lit("content of chunk "), v).alias("content"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=v.cast("decimal(18,6)"))).alias("created_at"),
        "label",
        "embedding",
    )


CHUNKS_SQL = f"""chunks AS (
  SELECT vec_id, concat(vec_id // 5, '_', vec_id % 5) AS chunk_id, CAST(vec_id // 5 AS VARCHAR) AS document_id, concat('file', vec_id // 5, '.txt') AS filename,
         'txt' AS file_type, CAST(vec_id % 5 + 1 AS INTEGER) AS page_number, concat('D', label) AS department,
         [concat('t', vec_id % 3), concat('u', vec_id % 4)] AS tags, CASE WHEN vec_id % 4 = 0 THEN 'table' ELSE 'text' END AS chunk_type,
         concat('content of chunk ', vec_id) AS content, TIMESTAMP '{START}' + to_seconds(vec_id) AS created_at, label, embedding
  FROM embeddings)"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_vector): every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


#: (query_id, chunk columns, score, rank) of an exact search, the query itself left out.
SCORED_SQL = f"""scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, c.*,
         round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings q, chunks c WHERE q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id)"""

#: Question openings, one for each intent and some for none.
TEMPLATES = (
    "What is the policy on",
    "How do I submit",
    "how to request",
    "Who should I contact for",
    "When is the deadline for",
    "deadline for",
    "What do I need for",
    "requirements for",
    "What is",
    "define",
    "Give me a quick overview of",
    "summary of",
    "When will I receive",
    "Tell me about",
    "Show that policy for",
    "and what about it in",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, conv_id, turn, question, asked_at) from the user turns of ``conversations``."""
    opening = F.element_at(F.array(*map(F.lit, TEMPLATES)), ((F.col("conv_id") + F.col("turn")) % len(TEMPLATES) + 1).cast("int"))
    rows = conversations(spark, sf_dir).filter("role = 'user'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "conv_id", "turn", F.concat_ws(" ", opening, "text").alias("question"), F.col("ts").alias("asked_at"))


QUESTIONS_SQL = f"""conv AS (
  SELECT conv_id, turn, role, text, TIMESTAMP '{START}' + to_minutes(conv_id) + to_seconds(turn) AS ts FROM conversations
), questions AS (
  SELECT conv_id * 100 + turn AS query_id, conv_id, turn, concat({list(TEMPLATES)!r}[CAST((conv_id + turn) % {len(TEMPLATES)} + 1 AS INTEGER)], ' ', text) AS question, ts AS asked_at
  FROM conv WHERE role = 'user')"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with a time for each turn."""
    return conversations_of(table(spark, sf_dir, "conversations"))


def conversations_of(turns: DataFrame) -> DataFrame:
    ts = F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("conv_id").cast("int"), secs=F.col("turn").cast("decimal(18,6)"))
    return turns.select("conv_id", "turn", "role", "text", ts.alias("ts"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from ``events``."""
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").alias("asked_at"),
        F.col("user_id").alias("key"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens_in"),
        (F.get_json_object("props", "$.k").cast("long") % 50 + 1).alias("tokens_out"),
        (F.col("event_id") % 17 == 0).alias("fallback"),
    )


REQUESTS_SQL = """requests AS (
  SELECT event_id, ts AS asked_at, user_id AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 + 1 AS tokens_out, event_id % 17 = 0 AS fallback
  FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads from ``documents``."""
    kind = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".pdf", ".xyz"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat("source", F.lit("_"), "doc_id", kind).alias("filename"),
        F.substring(kind, 2, 9).alias("file_type"),
        F.col("n_chars").cast("long").alias("file_size"),
        F.col("source").alias("department"),
        F.concat("lang", F.lit(" , "), "source").alias("tags"),
        F.col("lang").alias("language"),
        "text",
    )


FILES_SQL = """files AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, concat(source, '_', doc_id, ['.txt', '.md', '.pdf', '.xyz'][CAST(doc_id % 4 + 1 AS INTEGER)]) AS filename,
         ['txt', 'md', 'pdf', 'xyz'][CAST(doc_id % 4 + 1 AS INTEGER)] AS file_type, CAST(n_chars AS BIGINT) AS file_size, source AS department, concat(lang, ' , ', source) AS tags, lang AS language, text
  FROM documents)"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, name, headers, rows): parts by brand and thousand of keys, so that no table grows with the data; some cells null, padded or over-long rows among them."""
    row = F.array(F.col("p_partkey").cast("string"), F.concat(F.lit("  "), "p_name", F.lit(" \t ")), F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size").cast("string")), F.concat(F.lit("1_"), F.col("p_size").cast("string")))
    ragged = F.when(F.col("p_partkey") % 11 == 0, F.slice(row, 1, 2)).when(F.col("p_partkey") % 13 == 0, F.concat(row, F.array(F.lit("more|one")))).otherwise(row)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", ragged.alias("cells")))), lambda x: x["cells"])
    span = F.expr("p_partkey div 1000").alias("span")
    return table(spark, sf_dir, "part").groupBy("p_brand", span).agg(rows.alias("rows")).select(F.concat_ws("_", "p_brand", "span").alias("table_id"), F.when(F.col("p_brand").endswith("5"), "").otherwise(F.concat(F.lit("Parts of "), "p_brand")).alias("name"), F.when(F.col("p_brand").endswith("4"), F.array(F.lit(""), F.lit(" "))).otherwise(F.array(F.lit("Part Key"), F.lit(" Name "), F.lit("Size"), F.lit("Retail-Price"))).alias("headers"), "rows")


TABLES_SQL = """part_rows AS (
  SELECT p_brand, p_partkey, [CAST(p_partkey AS VARCHAR), concat('  ', p_name, ' ', chr(9), ' '), CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END, concat('1_', p_size)] AS r FROM part
), tables_ AS (
  SELECT concat(p_brand, '_', p_partkey // 1000) AS table_id, CASE WHEN p_brand LIKE '%5' THEN '' ELSE concat('Parts of ', p_brand) END AS name,
         CASE WHEN p_brand LIKE '%4' THEN ['', ' '] ELSE ['Part Key', ' Name ', 'Size', 'Retail-Price'] END AS headers,
         list(CASE WHEN p_partkey % 11 = 0 THEN r[1:2] WHEN p_partkey % 13 = 0 THEN list_concat(r, ['more|one']) ELSE r END ORDER BY p_partkey) AS rows
  FROM part_rows GROUP BY p_brand, p_partkey // 1000)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk store of texts: the lines of ``documents``, ten to a page."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("department"), F.posexplode(F.split("text", "\n")).alias("place", "content")).filter("trim(content) <> ''")
    return found.select((F.col("doc_id") * 1_000_000 + F.col("place")).alias("vec_id"), "department", F.expr("place div 10 + 1").cast("int").alias("page_number"), "content")


LINES_SQL = """lines AS (
  SELECT doc_id * 1000000 + place AS vec_id, department, CAST(place // 10 + 1 AS INTEGER) AS page_number, content
  FROM (SELECT doc_id, source AS department, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents) WHERE trim(content) <> '')"""
