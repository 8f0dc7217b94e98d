"""Registered queries of questions, conversations, cache, telemetry and catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators import cache, catalogue, conversation, intents, telemetry
from docquery.plans.search_plans import HINTS_SQL, INTENT_SQL, needs_sql
from docquery.sources import fixtures as fx
from docquery.sources.storage import cut, scratch

C, Q, R, FI = fx.CHUNKS_SQL, fx.QUESTIONS_SQL, fx.REQUESTS_SQL, fx.FILES_SQL
TTL = 24 * 3600


def understood(spark: SparkSession, sf: str) -> DataFrame:
    return intents.understood(fx.questions(spark, sf))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.conversations(spark, sf)
    return conversation.with_history(t.withColumn("text", F.when(F.col("turn") == 4, "").otherwise(F.col("text"))))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", "prior_turns", conversation.needs_rewrite("text").alias("needs"), conversation.rewrite_gate(F.col("prior_turns"), F.col("text")).alias("gate"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('  "'), "text", F.lit('" '))).when(F.col("turn") % 3 == 1, "  ")
    return t.select("conv_id", "turn", F.md5(conversation.rewrite_prompt(F.col("history"), F.col("text"))).alias("prompt_md5"), F.md5(conversation.rewritten(answer, F.col("text"))).alias("rewritten_md5"), F.md5(conversation.history_text(F.col("history"))).alias("history_md5"))


def prefixed(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).filter("role = 'user'")
    return t.select("conv_id", "turn", conversation.with_context_prefix(F.col("text"), F.col("last_user")).alias("query"))


TURNS_SQL = """said AS (SELECT conv_id, turn, role, CASE WHEN turn = 4 THEN '' ELSE text END AS text, ts FROM conv), turns AS (
  SELECT conv_id, turn, role, text, ts, count(*) OVER before AS prior_turns, coalesce(list({'role': role, 'text': text}) OVER last6, []) AS history,
         last_value(CASE WHEN role = 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END IGNORE NULLS) OVER before AS last_user
  FROM said WHERE text <> ''
  WINDOW before AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last6 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))"""
NEEDS_SQL = needs_sql("text")


def _history_sql(chars: int) -> str:
    return f"array_to_string(list_transform(history, lambda h: concat(upper(h.role[1]), lower(h.role[2:]), ': ', substring(h.text, 1, {chars}))), chr(10))"


PROMPT_SQL = f"concat('Conversation history (most recent last):', chr(10), {_history_sql(400)}, chr(10), chr(10), 'Follow-up question: ', text, chr(10), chr(10), 'Rewritten standalone question:')"


def appended(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.conversations(spark, sf)
    new = t.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max("ts").alias("ts")).select("conv_id", (F.col("last") + 1).alias("turn"), F.lit("user").alias("role"), F.lit("one more").alias("text"), (F.col("ts") + F.expr("interval 9 seconds")).alias("ts"))
    return conversation.appended(t, new, 4).select("conv_id", "turn", "role", "text")


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    return cache.replay(fx.requests(spark, sf), TTL)


REPLAY_SQL = f"""WITH RECURSIVE {R}, numbered AS (SELECT event_id, key, asked_at, row_number() OVER (PARTITION BY key ORDER BY asked_at, event_id) AS n FROM requests),
fold AS (
  SELECT event_id, key, n, false AS hit, asked_at + to_seconds({TTL}) AS until FROM numbered WHERE n = 1
  UNION ALL SELECT r.event_id, r.key, r.n, r.asked_at < f.until, CASE WHEN r.asked_at < f.until THEN f.until ELSE r.asked_at + to_seconds({TTL}) END FROM fold f JOIN numbered r ON r.key = f.key AND r.n = f.n + 1)"""


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Requests against entries written by every 20th request, void where an invalidation (every 997th) lies between."""
    log = fx.requests(spark, sf)
    asked = log.select(F.col("event_id").alias("request_id"), "key", "asked_at")
    entries = log.filter("event_id % 20 = 0").select("key", F.col("asked_at").alias("cached_at"), F.col("event_id").alias("response"))
    return cache.lookup(asked, entries, TTL)


LOOKUP_SQL = f"""WITH {R}, live AS (SELECT a.event_id AS request_id, e.event_id AS response, e.asked_at AS cached_at, row_number() OVER (PARTITION BY a.event_id ORDER BY e.asked_at DESC) AS n
  FROM requests a JOIN requests e ON a.key = e.key AND e.event_id % 20 = 0 AND e.asked_at <= a.asked_at AND a.asked_at < e.asked_at + to_seconds({TTL}))
SELECT a.event_id AS request_id, key, asked_at, cached_at, response, response IS NOT NULL AS hit FROM requests a LEFT JOIN live l ON l.request_id = a.event_id AND n = 1"""


def invalidated(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.requests(spark, sf)
    asked = log.select(F.col("event_id").alias("request_id"), "key", "asked_at")
    entries = log.filter("event_id % 20 = 0").select("key", F.col("asked_at").alias("cached_at"), F.col("event_id").alias("response"))
    voids = log.filter("event_id % 997 = 0").select(F.col("asked_at").alias("at"))
    return cache.lookup(asked, entries, TTL, voids).select("request_id", "hit", "response")


INVALID_SQL = f"""WITH {R}, voids AS (SELECT asked_at AS void_at FROM requests WHERE event_id % 997 = 0), live AS (SELECT a.event_id AS request_id, e.event_id AS response, row_number() OVER (PARTITION BY a.event_id ORDER BY e.asked_at DESC) AS n
  FROM requests a JOIN requests e ON a.key = e.key AND e.event_id % 20 = 0 AND e.asked_at <= a.asked_at AND a.asked_at < e.asked_at + to_seconds({TTL}) WHERE NOT EXISTS (SELECT 1 FROM voids WHERE void_at > e.asked_at AND void_at <= a.asked_at))
SELECT a.event_id AS request_id, response IS NOT NULL AS hit, response FROM requests a LEFT JOIN live l ON l.request_id = a.event_id AND n = 1"""


def admission(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = catalogue.admitted(fx.files(spark, sf), most=5000)
    cols = ["document_id", "filename", "file_size"]
    tags = F.array_join("tags", "|").alias("tags")
    return good.select(*cols, tags, F.lit("").alias("reason")).unionByName(bad.select(*cols, tags, "reason"))


ADMISSION_SQL = f"WITH {FI} SELECT document_id, filename, file_size, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags, CASE WHEN file_type = 'xyz' THEN 'unsupported type: .xyz' WHEN file_size > 5000 THEN 'too large' ELSE '' END AS reason FROM files"


def newer(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.chunks(spark, sf).select("chunk_id", "document_id", "content", "created_at", "vec_id")
    new = s.filter("vec_id % 10 = 0").withColumns({"content": F.lit("new"), "created_at": F.col("created_at") + F.expr("interval 1 day")})
    more = s.filter("vec_id % 10 = 1").withColumns({"chunk_id": F.concat("chunk_id", F.lit("_b")), "content": F.lit("more")})
    return catalogue.upserted(s, new.unionByName(more)).select("chunk_id", "document_id", "content")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """A store on disk into which newer chunks of one department come, and out of which the documents of another go: its rows, and whether their files are new."""
    path = scratch(spark, "store")
    s = fx.chunks(spark, sf).select("chunk_id", F.concat("document_id", F.lit("_"), "department").alias("document_id"), "content", "created_at", "department", "label")
    catalogue.write_store(s, path)
    old = spark.read.parquet(path).select(F.input_file_name().alias("file")).distinct()
    old = cut(old)
    catalogue.upsert_store(s.filter("label = 1").withColumns({"content": F.lit("new"), "created_at": F.col("created_at") + F.expr("interval 1 day")}), path)
    catalogue.delete_from_store(spark, s.filter("department = 'D2'").select("document_id"), path)
    now = spark.read.parquet(path).select("chunk_id", "department", "content", F.input_file_name().alias("file"))
    return now.join(old.withColumn("old", F.lit(True)), "file", "left").select("chunk_id", "department", "content", F.col("old").isNull().alias("written"))


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of durations from daily sketches, and whether each's rank among all durations is within the sketch's bound."""
    log = fx.requests(spark, sf)
    found = telemetry.duration_quantiles(telemetry.duration_sketches(log))
    met = log.filter("latency_ms is not null").select("method", "endpoint", F.col("latency_ms").alias("own")).join(found, ["method", "endpoint"])
    ranks = met.groupBy("method", "endpoint", "quantile", "observations").agg(F.avg(F.when(F.col("own") < F.col("latency_ms"), 1.0).otherwise(0.0)).alias("below"), F.avg(F.when(F.col("own") <= F.col("latency_ms"), 1.0).otherwise(0.0)).alias("to"))
    slack = 0.01 + 1 / F.col("observations")
    return ranks.select("method", "endpoint", "quantile", "observations", ((F.col("below") <= F.col("quantile") + slack) & (F.col("to") >= F.col("quantile") - slack)).alias("within_bound"))


def gone(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.chunks(spark, sf)
    return s.filter(F.col("vec_id") % 15 == 0).select("document_id").distinct().unionByName(spark.createDataFrame([("none",)], "document_id string"))


LISTED_SQL = f"""{C}, listed AS (SELECT document_id, arg_min(filename, vec_id) AS filename, arg_min(file_type, vec_id) AS file_type, arg_min(department, vec_id) AS department, array_to_string(arg_min(tags, vec_id), ',') AS tags, min(created_at) AS upload_date, count(*) AS chunks_count, 'completed' AS status FROM chunks GROUP BY document_id)"""
GONE_SQL = "gone AS (SELECT DISTINCT CAST(vec_id // 5 AS VARCHAR) AS document_id FROM embeddings WHERE vec_id % 15 = 0 UNION ALL SELECT 'none')"

QUERIES = {
    "u1_intent": lambda spark, sf: understood(spark, sf).select("query_id", "question", "intent"),
    "u2_hints": lambda spark, sf: understood(spark, sf).select("query_id", "intent", "confidence", F.array_join(F.col("page_filter").cast("array<string>"), ",").alias("pages"), "boost"),
    "u3_expansion": lambda spark, sf: understood(spark, sf).select("query_id", "expanded"),
    "u4_u5_rewrite_gate": gated,
    "u6_u7_prompts": prompts,
    "u8_context_prefix": prefixed,
    "f7_prior_turns": lambda spark, sf: _turns(spark, sf).select("conv_id", "turn", "prior_turns", F.size("history").alias("kept")),
    "w1_history": lambda spark, sf: conversation.histories(fx.conversations(spark, sf), fx.conversations(spark, sf).filter("conv_id % 50 in (0, 3)").select("conv_id").unionByName(spark.createDataFrame([(-5,)], "conv_id long"))),
    "w2_append_trim": appended,
    "w3_evict": lambda spark, sf: conversation.evicted(fx.conversations(spark, sf), 25).select("conv_id", "turn"),
    "w4_summary": lambda spark, sf: conversation.summaries(fx.conversations(spark, sf)),
    "w5_recent": lambda spark, sf: conversation.recent(fx.conversations(spark, sf)),
    "w6_delete": lambda spark, sf: conversation.without(fx.conversations(spark, sf), fx.conversations(spark, sf).filter("conv_id % 3 = 0").select("conv_id").distinct()).select("conv_id", "turn"),
    "w7_stats": lambda spark, sf: conversation.stats(fx.conversations(spark, sf)),
    "w8_prompt_history": lambda spark, sf: _turns(spark, sf).select("conv_id", "turn", F.array_join(F.transform("history", lambda h: F.concat_ws("=", h["role"], F.md5(h["text"]))), ",").alias("history")),
    "x5_request_id": lambda spark, sf: fx.questions(spark, sf).select("query_id", F.substring(F.md5(F.concat_ws(":", "question", F.unix_micros("asked_at").cast("string"))), 1, 12).alias("request_id")),
    "c0_cache_key": lambda spark, sf: fx.questions(spark, sf).select("query_id", cache.cache_key(F.col("question"), '{"department": "D1"}').alias("cache_key")),
    "c1_cache_lookup": looked_up,
    "c2_cache_replay": replayed,
    "c3_cache_invalidation": invalidated,
    "g1_request_counts": lambda spark, sf: telemetry.request_counts(fx.requests(spark, sf)),
    "g2_quantiles": quantiles,
    "g2_durations": lambda spark, sf: telemetry.durations(fx.requests(spark, sf)),
    "g3_g4_model_totals": lambda spark, sf: telemetry.model_totals(fx.requests(spark, sf)),
    "g5_hit_rate": lambda spark, sf: telemetry.hit_rate(replayed(spark, sf)),
    "g8_exposition": lambda spark, sf: telemetry.exposition(telemetry.request_counts(fx.requests(spark, sf)), "requests_total", ["method", "endpoint", "status"], "requests"),
    "s2_admission": admission,
    "s5_flattened": lambda spark, sf: catalogue.flattened(fx.chunks(spark, sf).select("chunk_id", "tags", F.when(F.col("vec_id") % 2 == 0, F.col("page_number")).alias("page_number"))),
    "s6_upsert": newer,
    "s6_stored_upsert": stored,
    "s7_delete": lambda spark, sf: catalogue.deleted(fx.chunks(spark, sf), gone(spark, sf)).select("chunk_id", "document_id"),
    "s7_delete_report": lambda spark, sf: catalogue.deletion_report(fx.chunks(spark, sf), gone(spark, sf)),
    "a1_listing": lambda spark, sf: catalogue.listed(fx.chunks(spark, sf)),
    "a2_page": lambda spark, sf: catalogue.page(catalogue.listed(fx.chunks(spark, sf)), 20, 20),
    "a3_document": lambda spark, sf: catalogue.one_document(fx.chunks(spark, sf), "12"),
    "a4_count": lambda spark, sf: fx.chunks(spark, sf).agg(F.count("*").alias("n")),
}

SQL = {
    "u1_intent": f"WITH {Q} SELECT query_id, question, {INTENT_SQL} AS intent FROM questions",
    "u2_hints": f"WITH {Q}, {HINTS_SQL}, named AS (SELECT query_id, {INTENT_SQL} AS intent FROM questions) SELECT query_id, intent, confidence::DOUBLE AS confidence, array_to_string(page_filter, ',') AS pages, boost FROM named JOIN hints USING (intent)",
    "u3_expansion": f"WITH {Q}, {HINTS_SQL}, named AS (SELECT query_id, question, {INTENT_SQL} AS intent FROM questions) SELECT query_id, concat_ws(' ', question, terms) AS expanded FROM named JOIN hints USING (intent)",
    "u4_u5_rewrite_gate": f"WITH {Q}, {TURNS_SQL} SELECT conv_id, turn, prior_turns, {NEEDS_SQL} AS needs, prior_turns >= 2 AND {NEEDS_SQL} AS gate FROM turns",
    "u6_u7_prompts": f"WITH {Q}, {TURNS_SQL} SELECT conv_id, turn, md5({PROMPT_SQL}) AS prompt_md5, md5(CASE WHEN turn % 3 = 0 THEN coalesce(nullif(regexp_replace(regexp_replace(concat('\"', text, '\"'), '^\\s+|\\s+$', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g'), ''), text) ELSE text END) AS rewritten_md5, md5({_history_sql(400)}) AS history_md5 FROM turns",
    "u8_context_prefix": f"WITH {Q}, {TURNS_SQL} SELECT conv_id, turn, CASE WHEN last_user IS NOT NULL AND last_user <> '' AND substring(lower(last_user), 1, 80) <> substring(lower(text), 1, 80) THEN concat('Context: ', substring(last_user, 1, 120), ' | Question: ', text) ELSE text END AS query FROM turns WHERE role = 'user'",
    "f7_prior_turns": f"WITH {Q}, {TURNS_SQL} SELECT conv_id, turn, prior_turns, CAST(len(history) AS INTEGER) AS kept FROM turns",
    "w1_history": "SELECT i.conv_id, m.place, m.role, m.text FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 50 IN (0, 3) UNION ALL SELECT -5) AS i LEFT JOIN (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, role, text FROM conversations) m USING (conv_id)",
    "w2_append_trim": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'one more' FROM conversations GROUP BY conv_id)) WHERE back <= 4",
    "w3_evict": f"WITH {Q} SELECT conv_id, turn FROM conv WHERE conv_id IN (SELECT conv_id FROM conv GROUP BY conv_id ORDER BY max(ts) DESC, conv_id LIMIT 25)",
    "w4_summary": f"WITH {Q} SELECT conv_id, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS message_count FROM conv GROUP BY conv_id",
    "w5_recent": f"WITH {Q} SELECT conv_id, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS message_count FROM conv GROUP BY conv_id ORDER BY updated_at DESC, conv_id LIMIT 20",
    "w6_delete": "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0",
    "w7_stats": "SELECT count(DISTINCT conv_id) AS total_conversations, count(*) AS total_messages, 1000 AS max_conversations, 50 AS max_messages FROM conversations",
    "w8_prompt_history": f"WITH {Q}, {TURNS_SQL} SELECT conv_id, turn, array_to_string(list_transform(history, lambda h: concat(h.role, '=', md5(h.text))), ',') AS history FROM turns",
    "x5_request_id": f"WITH {Q} SELECT query_id, substring(md5(concat(question, ':', epoch_us(asked_at))), 1, 12) AS request_id FROM questions",
    "c0_cache_key": f"WITH {Q} SELECT query_id, concat('rag:query:', md5(concat('{{\"filters\": {{\"department\": \"D1\"}}, \"question\": \"', replace(replace(replace(regexp_replace(lower(question), '^\\s+|\\s+$', '', 'g'), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), '\"}}'))) AS cache_key FROM questions",
    "c1_cache_lookup": LOOKUP_SQL,
    "c2_cache_replay": f"{REPLAY_SQL} SELECT event_id, key, hit FROM fold",
    "c3_cache_invalidation": INVALID_SQL,
    "g1_request_counts": f"WITH {R} SELECT method, endpoint, status, count(*) AS requests FROM requests GROUP BY ALL",
    "g2_quantiles": f"WITH {R}, q AS (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS quantile) SELECT method, endpoint, CAST(quantile AS DOUBLE) AS quantile, count(latency_ms) AS observations, true AS within_bound FROM requests, q GROUP BY ALL HAVING count(latency_ms) > 0",
    "s6_stored_upsert": f"WITH {C} SELECT chunk_id, department, CASE WHEN label = 1 THEN 'new' ELSE content END AS content, label = 1 AS written FROM chunks WHERE department <> 'D2'",
    "g2_durations": f"WITH {R} SELECT method, endpoint, count(*) AS observations, round(sum(latency_ms), 4) AS total_ms, round(avg(latency_ms), 6) AS mean_ms FROM requests GROUP BY ALL",
    "g3_g4_model_totals": f"WITH {R} SELECT count(*) AS total_requests, count(*) FILTER (status < 500) AS successful, count(*) FILTER (status >= 500) AS failed, CAST(coalesce(sum(tokens_in) FILTER (status < 500), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out) FILTER (status < 500), 0) AS BIGINT) AS tokens_out, count(*) FILTER (fallback) AS fallbacks, round(100.0::DOUBLE * count(*) FILTER (status < 500) / greatest(count(*), 1), 2) AS success_rate, round(coalesce(sum(latency_ms), 0) / greatest(count(*), 1), 2) AS average_latency_ms FROM requests",
    "g5_hit_rate": f"{REPLAY_SQL} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) AS hit_rate FROM fold",
    "g8_exposition": f"WITH {R}, c AS (SELECT concat('method=\"', method, '\",endpoint=\"', endpoint, '\",status=\"', status, '\"') AS labels, count(*)::DOUBLE AS value FROM requests GROUP BY method, endpoint, status) SELECT 'requests_total' AS name, labels, 'counter' AS type, value, concat('requests_total{{', labels, '}} ', value) AS line FROM c",
    "s2_admission": ADMISSION_SQL,
    "s5_flattened": f"WITH {C} SELECT chunk_id, array_to_string(tags, ',') AS tags, CASE WHEN vec_id % 2 = 0 THEN CAST(page_number AS VARCHAR) ELSE '' END AS page_number FROM chunks",
    "s6_upsert": f"WITH {C} SELECT chunk_id, document_id, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE content END AS content FROM chunks UNION ALL SELECT chunk_id || '_b', document_id, 'more' FROM chunks WHERE vec_id % 10 = 1",
    "s7_delete": f"WITH {C}, {GONE_SQL} SELECT chunk_id, document_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone)",
    "s7_delete_report": f"WITH {C}, {GONE_SQL}, n AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) SELECT document_id, coalesce(n, 0) AS deleted_chunks, n IS NOT NULL AS deleted FROM gone LEFT JOIN n USING (document_id)",
    "a1_listing": f"WITH {LISTED_SQL} SELECT * FROM listed",
    "a2_page": f"WITH {LISTED_SQL} SELECT * FROM listed ORDER BY upload_date, document_id LIMIT 20 OFFSET 20",
    "a3_document": f"WITH {LISTED_SQL} SELECT * FROM listed WHERE document_id = '12'",
    "a4_count": f"WITH {C} SELECT count(*) AS n FROM chunks",
}
