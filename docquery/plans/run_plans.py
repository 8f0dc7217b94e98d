"""Registered queries of whole runs: metadata, logs, table admission, evaluation, snapshots and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators import cache, catalogue, chunking, conversation, evaluation, metrics, telemetry
from docquery.operators import tables as tb
from docquery.plans import memory_plans, text_plans
from docquery.plans.search_plans import ranking_sql
from docquery.sources import fixtures as fx
from docquery.sources.storage import scratch
from docquery.sources.tables import table

FI, T, R = fx.FILES_SQL, fx.TABLES_SQL, fx.REQUESTS_SQL


def logged(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every file. Every fifth has two tables, of every tenth from the third on they are malformed; a fourth are of a format that is not read; chunks by lines and tables, none for short texts."""
    tables = F.when(F.col("document_id") % 10 == 3, '[[["a", "b"], ["1"').when(F.col("document_id") % 5 == 0, '[[["a", "b"], ["1", "2"]], [["c"]]]')
    files = catalogue.parsed(fx.files(spark, sf).withColumn("tables", tables), tables="tables")
    good = files.filter("error is null")
    lines = good.filter(chunking.count_tokens(F.col("text")) >= 100).select("document_id", F.explode(F.split("text", "\n")).alias("content"))
    return catalogue.ingest_log(files, lines.unionByName(good.select("document_id", F.explode("table_rows").alias("t")).select("document_id", F.to_json("t").alias("content"))))


LOGGED_SQL = f"""{FI}, faults AS (
  SELECT document_id, filename, text, CASE WHEN document_id::BIGINT % 4 = 3 THEN 'Unsupported file format: .xyz' WHEN document_id::BIGINT % 10 = 3 THEN concat('Malformed tables in ', filename) END AS error FROM files
), counts_ AS (
  SELECT *, CASE WHEN error IS NULL AND document_id::BIGINT % 5 = 0 THEN 2 ELSE 0 END AS tables_count, CASE WHEN error IS NULL AND length(text) // 4 >= 100 THEN CAST(len(string_split(text, chr(10))) AS BIGINT) ELSE 0 END AS lines_count FROM faults
), logged AS (
  SELECT document_id, filename, lines_count + tables_count AS chunks_count, CAST(tables_count AS INTEGER) AS tables_count, CASE WHEN error IS NOT NULL THEN 'failed' WHEN lines_count + tables_count > 0 THEN 'completed' ELSE 'warning' END AS status, error FROM counts_)"""


def raw_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of pages: a brand is a document, three of its tables are a page; those of every tenth brand have a header row alone."""
    t = fx.tables(spark, sf)
    rows = F.when(F.col("table_id").startswith("Brand#13"), F.slice("rows", 1, 1)).otherwise(F.col("rows"))
    span = F.substring_index("table_id", "_", -1).cast("int")
    return t.select("table_id", F.substring_index("table_id", "_", 1).alias("document_id"), rows.alias("rows"), (F.floor(span / 3) + 1).cast("int").alias("page_number"), span.alias("place"))


RAW_SQL = f"{T}, raw AS (SELECT *, place // 3 + 1 AS page_number FROM (SELECT table_id, string_split(table_id, '_')[1] AS document_id, CASE WHEN table_id LIKE 'Brand#13%' THEN rows[1:1] ELSE rows END AS rows, CAST(string_split(table_id, '_')[2] AS INTEGER) AS place FROM tables_))"


def section_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The same tables in sectioned documents: before every other one stands a heading, the first of every fifth brand has none before it."""
    t = raw_tables(spark, sf)
    tables = t.select("document_id", (F.col("place") * 2 + 1).alias("place"), F.lit("table").alias("type"), F.lit("").alias("text"), "rows", "table_id")
    heads = t.filter("place % 2 = 0 and not (place = 0 and document_id like '%5')").select("document_id", (F.col("place") * 2).alias("place"), F.lit("heading").alias("type"), F.concat(F.lit(" Part "), F.col("place"), F.lit(" \n")).alias("text"))
    found = tb.section_tables(tables.unionByName(heads, allowMissingColumns=True))
    return found.select("table_id", "name", "section", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "\n")).alias("rows_md5"))


_STRIP = r"list_transform({}, lambda c: regexp_replace(coalesce(c, ''), '^\s+|\s+$', '', 'g'))"
SECTIONS_SQL = rf"""WITH {RAW_SQL} SELECT table_id, concat('Table_', len(rows), 'rows') AS name,
  CASE WHEN place < 2 AND document_id LIKE '%5' THEN '' ELSE concat('Part ', place // 2 * 2) END AS section,
  array_to_string({_STRIP.format('rows[1]')}, '|') AS headers, CAST(len(rows) - 1 AS INTEGER) AS n_rows,
  md5(array_to_string(list_transform(rows[2:], lambda r: array_to_string({_STRIP.format('r')}, '~')), chr(10))) AS rows_md5 FROM raw"""


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of conversations as cases; each retrieves its own turn and the next ones, of which those of the same parity are relevant. Cases of every eleventh conversation have no answer."""
    pairs = text_plans.pairs(spark, sf)
    ranks = pairs.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("query_id") + i)).alias("rank", "id")).withColumn("rank", F.col("rank") + 1)
    relevant = ranks.filter((F.col("id") % 3) == (F.col("query_id") % 2)).select("query_id", "id")
    ranked = metrics.ranking(pairs.select("query_id"), ranks, relevant)
    cases = pairs.select("query_id", F.concat(F.lit("conversation of "), F.col("query_id") % 7, F.lit(" in seven")).alias("category"))
    return evaluation.evaluated(cases, ranked, pairs.filter((F.col("query_id") / 100).cast("long") % 11 != 0))


RANKS_SQL = "SELECT query_id, query_id + i AS id, i + 1 AS rank FROM pairs, range(6) AS r(i)"
_TRUTH = "SELECT query_id, CASE WHEN coalesce(ground_truth, '') <> '' THEN ground_truth ELSE answer END AS reference, answer FROM pairs WHERE (query_id // 100) % 11 <> 0"
EVALUATED_SQL = f"""WITH RECURSIVE {text_plans.FAITHFUL_SQL}, {text_plans.bleu_sql(_TRUTH)}, {text_plans.rouge_l_sql(_TRUTH)}, {text_plans.HALLUCINATED_SQL}, {text_plans.CITED_SQL},
{ranking_sql('SELECT query_id FROM pairs', RANKS_SQL, f'SELECT query_id, id FROM ({RANKS_SQL}) WHERE id % 3 = query_id % 2')},
near_ AS (SELECT query_id, {text_plans.similarity_sql('q', 'a')} AS answer_relevancy, CASE WHEN coalesce(ground_truth, '') <> '' THEN {text_plans.similarity_sql('a', 'r')} ELSE faithfulness END AS answer_correctness FROM counted JOIN faithful USING (query_id)),
text_ AS (SELECT * FROM bleu_ JOIN rouge_ USING (query_id) JOIN hallucinated_ USING (query_id) JOIN cited_ USING (query_id) JOIN near_ USING (query_id) JOIN faithful USING (query_id)),
joined_ AS (SELECT *, answer_relevancy AS semantic_similarity, concat('conversation of ', query_id % 7, ' in seven') AS category, CASE WHEN bleu IS NULL OR n_retrieved = 0 THEN 'no chunks or no answer' END AS error,
  0.4::DOUBLE * (precision + recall + ndcg) / 3 + 0.4::DOUBLE * (bleu + rouge_l + faithfulness) / 3 + 0.2::DOUBLE * (context_precision + context_recall + citation_accuracy) / 3 AS total FROM judged LEFT JOIN text_ USING (query_id)),
results AS (SELECT *, CASE WHEN error IS NULL THEN round(CASE WHEN hallucinated THEN total / 2 ELSE total END, 3) END AS overall FROM joined_)"""


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The message array of every user turn, with the conversation so far as context."""
    turns = conversation.with_history(fx.conversations(spark, sf)).filter("role = 'user'")
    return turns.select("conv_id", "turn", conversation.prompt_messages(F.col("history"), conversation.history_text(F.col("history")), F.col("text")).alias("messages"))


_HISTORY = "array_to_string(list_transform(history, lambda h: concat(upper(h.role[1]), lower(h.role[2:]), ': ', substring(h.text, 1, 400))), chr(10))"
_ANSWER = conversation.ANSWER_PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '").split("%s")
PROMPTS_SQL = f"""WITH turns AS (
  SELECT conv_id, turn, role, text, coalesce(list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS history FROM conversations WHERE text <> ''
) SELECT conv_id, turn, CAST(len(history) + 2 AS INTEGER) AS n, md5(concat('system={conversation.SYSTEM_PROMPT}', chr(10), array_to_string(list_concat(list_transform(history, lambda h: concat(h.role, '=', h.text)), [concat('user={_ANSWER[0]}', {_HISTORY}, '{_ANSWER[1]}', text, '{_ANSWER[2]}')]), chr(10)))) AS messages_md5 FROM turns WHERE role = 'user'"""


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """One row: totals of requests, models, cache and documents."""
    requests = fx.requests(spark, sf)
    one = telemetry.snapshot(requests, cache.replay(requests, memory_plans.TTL), catalogue.processed_totals(logged(spark, sf)))
    ends = F.array_join(F.transform(F.map_entries("http.requests_by_endpoint"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return one.select("http.requests_total", ends.alias("by_endpoint"), "llm.*", "cache.*", "documents.*")


SNAPSHOT_SQL = f"""{memory_plans.REPLAY_SQL}, {LOGGED_SQL},
ends AS (SELECT string_agg(concat(method, ':', endpoint, '=', n), ',' ORDER BY concat(method, ':', endpoint)) AS by_endpoint, CAST(sum(n) AS BIGINT) AS requests_total FROM (SELECT method, endpoint, count(*) AS n FROM requests GROUP BY ALL)),
cache_ AS (SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) AS hit_rate FROM fold),
docs_ AS (SELECT count(*) FILTER (status <> 'failed') AS documents_processed, CAST(coalesce(sum(chunks_count), 0) AS BIGINT) AS chunks_created, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'failed') AS failures FROM logged)
SELECT * FROM ends, cache_, docs_, (SELECT count(*) AS total_requests, count(*) FILTER (status < 500) AS successful, count(*) FILTER (status >= 500) AS failed, CAST(coalesce(sum(tokens_in) FILTER (status < 500), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out) FILTER (status < 500), 0) AS BIGINT) AS tokens_out, count(*) FILTER (fallback) AS fallbacks, round(100.0::DOUBLE * count(*) FILTER (status < 500) / greatest(count(*), 1), 2) AS success_rate, round(coalesce(sum(latency_ms), 0) / greatest(count(*), 1), 2) AS average_latency_ms FROM requests)"""


def files_read(spark: SparkSession, sf: str) -> DataFrame:
    """Items of ``benchmark`` written as text files in folders, some of a type that is not read, and read again by extension."""
    folder = scratch(spark, "files")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text")
    items.filter("item % 4 <> 3").write.partitionBy("item").text(folder)
    items.filter("item % 4 = 3").write.mode("append").partitionBy("item").csv(folder)
    read = catalogue.read_files(spark, folder)
    return read.select(F.regexp_extract("path", "item=([0-9]+)/", 1).cast("long").alias("item_id"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("text_md5"))


def cases_read(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation file, one JSON document of the benchmark's items, and the first 25 of its cases."""
    path = scratch(spark, "cases")
    case = F.struct(F.concat(F.lit("case_"), F.lpad("item_id", 9, "0")).alias("id"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("category"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "yes").alias("ground_truth"))
    # such a file is small: it is one document
    table(spark, sf, "benchmark").agg(F.sort_array(F.collect_list(case)).alias("test_cases")).write.json(path)
    return evaluation.read_cases(spark, path, 25).select("place", "id", "category", F.md5("question").alias("question_md5"), "ground_truth")


def report_read(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a run, written and read again."""
    path = scratch(spark, "report")
    evaluation.write_report(evaluation.projected(evaluated(spark, sf)), path, "top_k=5")
    kept = "query_id long, config string, chunks_retrieved long, overall double, error string"
    return spark.read.schema(kept).json(path)


QUERIES = {
    "s4_metadata": lambda spark, sf: catalogue.with_metadata(fx.files(spark, sf), category="report", version="1", language="xx").select("document_id", "filename", "language", "category", "version"),
    "s8_ingest_log": logged,
    "p4_page_tables": lambda spark, sf: tb.named_by_page(raw_tables(spark, sf)).select("table_id", "name", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows")),
    "p5_section_tables": section_tables,
    "x4_prompt_messages": lambda spark, sf: prompts(spark, sf).select("conv_id", "turn", F.size("messages").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "\n")).alias("messages_md5")),
    "g6_processed": lambda spark, sf: catalogue.processed_totals(logged(spark, sf)),
    "g7_snapshot": snapshot,
    "m17_overall": lambda spark, sf: evaluated(spark, sf).select("query_id", "overall", "error"),
    "m18_results": lambda spark, sf: evaluation.projected(evaluated(spark, sf)).select("query_id", "category", "retrieval.*", "generation.*", "end_to_end.*", "hallucination_detected", "chunks_retrieved"),
    "m19_evaluation_run": lambda spark, sf: evaluated(spark, sf).groupBy("category").agg(F.count("*").alias("cases"), F.count("error").alias("errors"), F.round(F.avg("overall"), 6).alias("mean_overall")),
    "m20_run_summary": lambda spark, sf: metrics.summary(evaluated(spark, sf)),
    "m21_display": lambda spark, sf: evaluation.displayed(evaluated(spark, sf)),
    "s1_s3_files": files_read,
    "s9_cases": cases_read,
    "s10_report": report_read,
}

_DIGITS = "printf('%.2f', round({c}, 2)) AS {c}"
SQL = {
    "s4_metadata": f"WITH {FI} SELECT md5(filename) AS document_id, filename, language, 'report' AS category, '1' AS version FROM files",
    "s8_ingest_log": f"WITH {LOGGED_SQL} SELECT * FROM logged",
    "p4_page_tables": f"WITH {RAW_SQL} SELECT table_id, concat('Table_', page_number, '_', row_number() OVER (PARTITION BY document_id, page_number ORDER BY place)) AS name, array_to_string(list_transform(rows[1], lambda c: coalesce(c, '')), '|') AS headers, CAST(len(rows) - 1 AS INTEGER) AS n_rows FROM raw QUALIFY len(rows) > 1",
    "p5_section_tables": SECTIONS_SQL,
    "g6_processed": f"WITH {LOGGED_SQL} SELECT count(*) FILTER (status <> 'failed') AS documents_processed, CAST(coalesce(sum(chunks_count), 0) AS BIGINT) AS chunks_created, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'failed') AS failures FROM logged",
    "x4_prompt_messages": PROMPTS_SQL,
    "g7_snapshot": SNAPSHOT_SQL,
    "m17_overall": f"{EVALUATED_SQL} SELECT query_id, overall, error FROM results",
    "m18_results": f"{EVALUATED_SQL} SELECT query_id, category, {', '.join(f'round({c}, 3) AS {c}' for names in evaluation.PARTS.values() for c in names)}, hallucinated AS hallucination_detected, n_retrieved AS chunks_retrieved FROM results",
    "m19_evaluation_run": f"{EVALUATED_SQL} SELECT category, count(*) AS cases, count(error) AS errors, round(avg(overall), 6) AS mean_overall FROM results GROUP BY category",
    "m20_run_summary": f"{EVALUATED_SQL}, means AS (SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid, {', '.join(f'round(avg(round({c}, 3)) FILTER (error IS NULL), 6) AS mean_{c}' for c in (*metrics.PASS_MARKS, 'context_precision'))}, count(*) FILTER (error IS NULL AND hallucinated) AS hallucinations FROM results) SELECT *, {', '.join(f'mean_{c} >= {m} AS {c}_passes' for c, m in metrics.PASS_MARKS.items())}, hallucinations = 0 AS no_hallucination FROM means",
    "m21_display": f"{EVALUATED_SQL} SELECT query_id, substring(category, 1, 12) AS category, {', '.join(_DIGITS.format(c=c) for c in ('precision', 'recall', 'ndcg', 'bleu', 'faithfulness', 'context_f1', 'overall'))}, CASE WHEN hallucinated THEN '✗' ELSE '✓' END AS hallucination FROM results WHERE error IS NULL",
    "s1_s3_files": "SELECT item_id, md5(text) AS text_md5 FROM benchmark WHERE item_id % 4 <> 3",
    "s9_cases": "SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS place, concat('case_', lpad(CAST(item_id AS VARCHAR), 9, '0')) AS id, concat('c', item_id % 3) AS category, md5(text) AS question_md5, CASE WHEN item_id % 2 = 0 THEN 'yes' END AS ground_truth FROM benchmark ORDER BY item_id LIMIT 25",
    "s10_report": f"{EVALUATED_SQL} SELECT query_id, 'top_k=5' AS config, n_retrieved AS chunks_retrieved, overall, error FROM results",
}
