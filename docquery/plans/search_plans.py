"""Registered queries of search, filters, fusion and ranking metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions.loaded import Loaded
from docquery.operators import conversation, embed, graph_index, intents, keyword_index, metrics, retrieval, search
from docquery.operators.filters import above, apply_filters
from docquery.sources import fixtures as fx
from docquery.sources.storage import cut, scratch
from docquery.sources.tables import table

C, S = fx.CHUNKS_SQL, fx.SCORED_SQL
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
HINTS_SQL = "hints AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', {h[0]}, {h[1] if h[1] else 'NULL::INTEGER[]'}, {h[2] if h[2] else 'NULL::DOUBLE'}, {repr(h[3]) if h[3] else 'NULL'})" for i, h in intents.HINTS.items()) + ") AS v(intent, confidence, page_filter, boost, terms))"
INTENT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(trim(lower(question)), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{i}'" for i, ps in intents.PATTERNS.items()) + " ELSE 'general' END"
FILTERS = {
    "f1_scalar": ({"department": "D3", "file_type": "", "chunk_type": None}, "department = 'D3'"),
    "f2_list": ({"department": ["D1", "", "D2", None], "chunk_type": []}, "department IN ('D1', 'D2')"),
    "f3_operators": ({"page_number": {"$gte": 2, "$lt": 5}, "chunk_type": {"$ne": "table"}, "department": {"$nin": ["D0"]}}, "page_number >= 2 AND page_number < 5 AND chunk_type <> 'table' AND department NOT IN ('D0')"),
    "f4_tags": ({"tags": "u3"}, "contains(array_to_string(tags, ','), 'u3')"),
    "f5_conjunction": ({"tags": "t1", "department": ["D1", "D2", "D3"], "page_number": {"$gte": 3}}, "contains(array_to_string(tags, ','), 't1') AND department IN ('D1', 'D2', 'D3') AND page_number >= 3"),
}
SHOWN = ["chunk_id", "document_id", "department", "page_number", "chunk_type"]


def _filter(filters):
    return lambda spark, sf: apply_filters(fx.chunks(spark, sf), filters).select(*SHOWN)


def exact(spark: SparkSession, sf: str, k: int = 10, filters=None, threshold=None) -> DataFrame:
    return search.top_k(apply_filters(fx.chunks(spark, sf), filters), fx.vector_queries(spark, sf), k, threshold=threshold)


def exact_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return exact(spark, sf, 10, {"chunk_type": "text", "page_number": {"$lte": 4}})


def single(spark: SparkSession, sf: str) -> DataFrame:
    query = [((i * 37) % 11 - 5) / 10 for i in range(64)]
    return search.top_k_single(fx.chunks(spark, sf), query, 10).select("vec_id", "score")


def hinted(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """2k results of each query with the hints of an intent: query vectors take intents in turn."""
    names = F.array(*[F.lit(i) for i in intents.HINTS])
    ranked = search.top_k(fx.chunks(spark, sf), fx.vector_queries(spark, sf), 2 * k, threshold=0.2)
    named = ranked.withColumn("intent", F.element_at(names, ((F.col("query_id") / fx.QUERY_EVERY).cast("int") % len(intents.HINTS) + 1).cast("int"))).join(F.broadcast(intents.rules(spark)), "intent")
    return named.withColumn("page_number", (F.col("vec_id") % 5 + 1).cast("int")).drop("terms", "confidence")


HINTED_SQL = f"""{C}, {S}, {HINTS_SQL}, hinted AS (
  SELECT * FROM (SELECT query_id, vec_id, score, page_number, {RANKED} AS rank, [{', '.join(f"'{i}'" for i in intents.HINTS)}][CAST((query_id // {fx.QUERY_EVERY}) % {len(intents.HINTS)} + 1 AS INTEGER)] AS intent FROM scored WHERE score >= 0.2) JOIN hints USING (intent) WHERE rank <= 20
), within AS (SELECT * FROM hinted WHERE rank <= CASE WHEN len(page_filter) > 0 THEN 20 ELSE 10 END),
boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC, rank) AS rank2 FROM (SELECT *, round(CASE WHEN coalesce(list_contains(page_filter, page_number), false) THEN score * coalesce(boost, 5.0) ELSE score END, 6) AS score2 FROM within))"""


def over_fetched(spark: SparkSession, sf: str) -> DataFrame:
    return search.within_k(hinted(spark, sf)).select("query_id", "vec_id", "score", "rank", "intent")


def boosted(spark: SparkSession, sf: str) -> DataFrame:
    return search.boosted(search.within_k(hinted(spark, sf))).select("query_id", "vec_id", "score", "rank", "intent")


def keyword(spark: SparkSession, sf: str) -> DataFrame:
    asked = fx.questions(spark, sf).filter(F.col("conv_id") % fx.QUERY_EVERY == 0)
    return search.bm25(table(spark, sf, "documents"), asked, 10)


def stored_keyword(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a stored index, of which a fifth of the documents came later."""
    path, docs = scratch(spark, "keywords"), table(spark, sf, "documents")
    keyword_index.append(docs.filter("doc_id % 5 > 0"), path)
    keyword_index.append(docs.filter("doc_id % 5 = 0"), path)
    return keyword_index.search(spark, path, fx.questions(spark, sf).filter(F.col("conv_id") % fx.QUERY_EVERY == 0), 10)


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
BM25_SQL = f"""WITH {fx.QUESTIONS_SQL}, wanted AS (
  SELECT query_id, unnest(list_distinct({TOKENS.format('question')})) AS term FROM questions WHERE conv_id % {fx.QUERY_EVERY} = 0
), sized AS (SELECT doc_id, {TOKENS.format('text')} AS words FROM documents),
stats AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM sized),
posted AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM wanted JOIN posted USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10"""


def by_page(spark: SparkSession, sf: str) -> DataFrame:
    """A second ranked list to fuse with: a query's hits of even ids, by id."""
    from pyspark.sql import Window

    hits = exact(spark, sf, 20).filter("vec_id % 2 = 0").drop("rank")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")))


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return search.fused(exact(spark, sf), by_page(spark, sf))


FUSED_SQL = f"""{C}, {S}, top20 AS (SELECT * FROM (SELECT query_id, vec_id, score, {RANKED} AS rank FROM scored) WHERE rank <= 20),
vectors AS (SELECT * FROM top20 WHERE rank <= 10),
keywords AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM top20 WHERE vec_id % 2 = 0),
summed AS (SELECT query_id, vec_id, round(sum(part), 12) AS score, min(place) AS place FROM (
  SELECT query_id, vec_id, 0.5::DOUBLE / (60 + rank) AS part, rank AS place FROM vectors UNION ALL SELECT query_id, vec_id, 0.5::DOUBLE / (60 + rank), rank + 1000000000 FROM keywords) GROUP BY query_id, vec_id),
fused AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, vec_id) AS INTEGER) AS rank FROM summed)"""


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return search.reranked(fused(spark, sf), 1 / (1 + F.col("vec_id") % 7))


DIMENSION = 64
RETRIEVE_FILTERS = {"page_number": {"$lte": 40}, "department": {"$nin": ["none"]}}


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with what their conversations say before them; every fourth turn has a model's rewrite."""
    turns = conversation.with_history(fx.conversations(spark, sf)).filter((F.col("role") == "user") & (F.col("conv_id") % fx.QUERY_EVERY == 0))
    own = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "conv_id", "turn", "prior_turns", "last_user")
    # by turn: the hundredth turn of the conversation before has the same id
    own = own.join(fx.questions(spark, sf).select("conv_id", "turn", "question"), ["conv_id", "turn"]).drop("conv_id")
    return own.withColumn("rewrite", F.when(F.col("turn") % 4 == 2, F.concat(F.lit('"'), "question", F.lit(" "), "last_user", F.lit('"'))))


def retrieved_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of conversations over the lines of all documents: rewriting, intents, expansion, prefix, vectors, filters, threshold, boost, keywords, fusion, rerank. Questions that find nothing are rows with rank 0."""
    model = Loaded(lambda: embed.HashedModel(DIMENSION))
    # an expression: vectors are made where they are compared, and stored nowhere
    chunks = fx.lines(spark, sf).withColumn("embedding", embed.model_vectors(model, 2000)(F.col("content")))
    questions = asked(spark, sf)
    found = retrieval.retrieve(chunks, questions, embed.model_vectors(model), lambda q, c: 1 / (1 + (F.length(q) + F.length(c)) % 7), filters=RETRIEVE_FILTERS)
    found = cut(found)  # read twice, found once
    none = search.without_results(questions, found).select("query_id", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank"))
    return found.unionByName(none)


_WORDS = [w for w in conversation.ANAPHORA if " " not in w]
_PHRASES = "|".join(w for w in conversation.ANAPHORA if " " in w)


def needs_sql(text: str) -> str:
    """Whether a text points back to an earlier turn."""
    return f"(list_has_any(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''), {_WORDS!r}) OR regexp_matches(lower({text}), '{_PHRASES}'))"


_NEEDS = needs_sql("question")
_HASHED = lambda t: rf"list_transform(range({DIMENSION}), lambda i: len(list_filter(list_transform(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT) % {DIMENSION}), lambda x: x = i))::DOUBLE)"
_UNIT = "CASE WHEN list_inner_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END"
RETRIEVED_SQL = f"""WITH {HINTS_SQL}, {fx.LINES_SQL}, said AS (
  SELECT conv_id, turn, role, text, count(*) OVER earlier AS prior_turns, last_value(CASE WHEN role = 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END IGNORE NULLS) OVER earlier AS last_user
  FROM conversations WHERE text <> '' WINDOW earlier AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), asked AS (
  SELECT conv_id * 100 + turn AS query_id, turn, prior_turns, last_user, concat({list(fx.TEMPLATES)!r}[CAST((conv_id + turn) % {len(fx.TEMPLATES)} + 1 AS INTEGER)], ' ', text) AS question
  FROM said WHERE role = 'user' AND conv_id % {fx.QUERY_EVERY} = 0
), alone AS (
  SELECT *, {INTENT_SQL} AS intent, CASE WHEN prior_turns >= 2 AND {_NEEDS} AND turn % 4 = 2 THEN coalesce(nullif(regexp_replace(concat(question, ' ', last_user), '^["'']+|["'']+$', '', 'g'), ''), question) ELSE question END AS rq FROM asked
), expanded AS (
  SELECT *, concat_ws(' ', rq, terms) AS ex FROM alone JOIN hints USING (intent)
), ready AS (
  SELECT *, CASE WHEN last_user IS NOT NULL AND last_user <> '' AND substring(lower(last_user), 1, 80) <> substring(lower(ex), 1, 80) THEN concat('Context: ', substring(last_user, 1, 120), ' | Question: ', ex) ELSE ex END AS enhanced FROM expanded
), own AS (SELECT * FROM lines WHERE page_number <= 40 AND department NOT IN ('none')
), cv AS (SELECT vec_id, {_UNIT} AS u FROM (SELECT vec_id, {_HASHED('content')} AS v FROM own)
), qv AS (SELECT query_id, {_UNIT} AS u FROM (SELECT query_id, {_HASHED('enhanced')} AS v FROM ready)
), scored AS (SELECT query_id, vec_id, round(list_inner_product(qv.u, cv.u), 6) AS score FROM qv, cv
), near AS (
  SELECT * FROM (SELECT query_id, vec_id, score, {RANKED} AS rank FROM scored WHERE score >= 0.3) JOIN ready USING (query_id) JOIN own USING (vec_id) WHERE rank <= CASE WHEN len(page_filter) > 0 THEN 20 ELSE 10 END
), lifted AS (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN coalesce(list_contains(page_filter, page_number), false) THEN score * coalesce(boost, 5.0) ELSE score END, 6) DESC, rank) AS rank FROM near
), wanted AS (SELECT query_id, unnest(list_distinct({TOKENS.format('enhanced')})) AS term FROM ready
), sized AS (SELECT vec_id, {TOKENS.format('content')} AS words FROM own
), stats AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM sized
), posted AS (SELECT vec_id, length, term, count(*) AS tf FROM (SELECT vec_id, len(words) AS length, unnest(words) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term
), keyed AS (SELECT query_id, vec_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM wanted JOIN posted USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, vec_id
), keywords AS (SELECT * FROM (SELECT query_id, vec_id, {RANKED} AS rank FROM keyed) WHERE rank <= 10
), summed AS (
  SELECT query_id, vec_id, round(sum(part), 12) AS score, min(place) AS place FROM (
    SELECT query_id, vec_id, 0.5::DOUBLE / (60 + rank) AS part, rank AS place FROM lifted UNION ALL SELECT query_id, vec_id, 0.5::DOUBLE / (60 + rank), rank + 1000000000 FROM keywords) GROUP BY query_id, vec_id
), fused AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, vec_id) AS rank FROM summed
), final AS (
  SELECT query_id, vec_id, score2 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC, rank, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, rank, round(0.3::DOUBLE * score + 0.7::DOUBLE * (1 / CAST(1 + (length(question) + length(content)) % 7 AS DOUBLE)), 6) AS score2 FROM fused JOIN own USING (vec_id) JOIN asked USING (query_id))
)
SELECT * FROM final WHERE rank <= 5 UNION ALL SELECT query_id, NULL, NULL, 0 FROM asked WHERE query_id NOT IN (SELECT query_id FROM final)"""


def unanswered(spark: SparkSession, sf: str) -> DataFrame:
    return search.without_results(fx.vector_queries(spark, sf), exact(spark, sf, 10, None, 0.45)).select("query_id", "status")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking metrics of the exact search; relevant: the other vectors of the query's label. Two more queries have nothing relevant, or nothing retrieved."""
    chunks = fx.chunks(spark, sf)
    queries = fx.vector_queries(spark, sf).select("query_id", F.col("query_label").alias("label")).unionByName(spark.createDataFrame([(-1, None), (-2, -2)], "query_id long, label int"))
    items = chunks.select(F.col("vec_id").alias("id"), "label").unionByName(spark.createDataFrame([(-3, -2)], "id long, label int"))
    retrieved = exact(spark, sf).select("query_id", "rank", F.col("vec_id").alias("id")).unionByName(spark.createDataFrame([(-1, 1, 1)], "query_id long, rank int, id long"))
    return metrics.ranking_by_label(queries, retrieved, items)


def ranking_sql(ids: str, retrieved: str, relevant: str) -> str:
    """Ranking metrics as CTEs up to ``judged``, from selects of (query_id), (query_id, id, rank) and (query_id, id)."""
    return f"""retrieved AS ({retrieved}), relevant AS ({relevant}), ids AS ({ids}),
n AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
found AS (SELECT r.query_id, count(DISTINCT r.id) FILTER (v.id IS NOT NULL AND rank <= 5) AS hk, count(DISTINCT r.id) FILTER (v.id IS NOT NULL) AS h, count(DISTINCT r.id) AS nr,
  min(rank) FILTER (v.id IS NOT NULL) AS first, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (v.id IS NOT NULL AND rank <= 5), 0) AS dcg
  FROM retrieved r LEFT JOIN relevant v ON r.query_id = v.query_id AND r.id = v.id GROUP BY r.query_id),
m AS (SELECT ids.query_id, coalesce(hk, 0) / 5.0::DOUBLE AS p, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE coalesce(hk, 0) / CAST(n AS DOUBLE) END AS r, coalesce(1.0::DOUBLE / first, 0) AS mrr,
  CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) END AS ndcg,
  CASE WHEN coalesce(nr, 0) = 0 THEN 1.0 ELSE h / CAST(nr AS DOUBLE) END AS cp, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE coalesce(h, 0) / CAST(n AS DOUBLE) END AS cr, coalesce(nr, 0) AS n_retrieved
  FROM ids LEFT JOIN found USING (query_id) LEFT JOIN n USING (query_id)),
judged AS (SELECT query_id, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(mrr, 6) AS mrr, round(CAST(ndcg AS DOUBLE), 6) AS ndcg,
  round(CAST(cp AS DOUBLE), 6) AS context_precision, round(CAST(cr AS DOUBLE), 6) AS context_recall, round(CASE WHEN cp + cr > 0 THEN 2 * cp * cr / (cp + cr) ELSE 0 END, 6) AS context_f1, n_retrieved FROM m)"""


JUDGED_SQL = f"{C}, {S}, " + ranking_sql(
    f"SELECT vec_id AS query_id FROM embeddings WHERE vec_id % {fx.QUERY_EVERY} = 0 UNION ALL SELECT -1 UNION ALL SELECT -2",
    f"SELECT * FROM (SELECT query_id, vec_id AS id, {RANKED} AS rank FROM scored) WHERE rank <= 10 UNION ALL SELECT -1, 1, 1",
    "SELECT query_id, vec_id AS id FROM scored WHERE label = query_label UNION ALL SELECT -2, -3",
)
METRICS = {"m1_precision": ["precision"], "m2_recall": ["recall"], "m3_f1": ["f1"], "m4_mrr": ["mrr"], "m5_ndcg": ["ndcg"], "m11_context_precision": ["context_precision"], "m12_context_recall": ["context_recall"], "m13_context_f1": ["context_f1"]}


def _metric(columns):
    return lambda spark, sf: judged(spark, sf).select("query_id", *columns)


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.transform(search.normalise(F.transform("embedding", lambda x: x * 3.0)), lambda x: F.round(x, 5))
    return fx.chunks(spark, sf).select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x), 3).alias("squares"), F.size(unit).alias("n"))


def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    cut = fx.chunks(spark, sf).select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = search.of_dimension(cut, 64)
    return good.select("vec_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("vec_id", "reason"))


def indexed(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Approximate search through an index of all rows: written for two thirds of them, the others appended. The beam is measured."""
    path, chunks = scratch(spark, "index"), fx.chunks(spark, sf).select("vec_id", "embedding")
    graph_index.write(chunks.filter("vec_id % 3 > 0"), path)
    graph_index.append(chunks.filter("vec_id % 3 = 0"), path)
    index, queries = graph_index.read(spark, path), fx.vector_queries(spark, sf)
    return graph_index.search(index, queries, k, beam=graph_index.beam_for(index, queries, k))


def index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """One row: queries, results, and whether the index finds 0.9 or more of what exact search finds."""
    want = exact(spark, sf).select("query_id", "vec_id")
    got = indexed(spark, sf).select("query_id", "vec_id", F.lit(1).alias("hit"))
    found = want.join(got, ["query_id", "vec_id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recall_reached"))


QUERIES = {
    "j1_exact_topk": exact,
    "j1_exact_topk_filtered": exact_filtered,
    "j2_single_topk": single,
    "j3_approximate_topk": indexed,
    "j3_index_recall": index_recall,
    "j4_bm25": keyword,
    "j4_stored_index": stored_keyword,
    "j5_page_overfetch": over_fetched,
    "j6_intent_boost": boosted,
    "j7_rank_fusion": fused,
    "j8_rerank": reranked,
    "j9_retrieve": retrieved_pipeline,
    "j10_no_results": unanswered,
    "j11_chunk_by_id": lambda spark, sf: apply_filters(fx.chunks(spark, sf), {"chunk_id": "7_3"}).select(*SHOWN, "content"),
    "f6_threshold": lambda spark, sf: above(exact(spark, sf), 0.30),
    "e3_normalise": normalised,
    "e4_dimension": dimensions,
    **{n: _filter(f) for n, (f, _) in FILTERS.items()},
    **{n: _metric(c) for n, c in METRICS.items()},
}
QUERIES["j3_sketch_topk"] = lambda spark, sf: search.approximate_top_k(fx.chunks(spark, sf), fx.vector_queries(spark, sf), 10)

SQL = {
    "j3_index_recall": f"SELECT count(*) AS queries, sum(least(10, others)) :: BIGINT AS wanted, true AS recall_reached FROM (SELECT vec_id, (SELECT count(*) FROM embeddings) - 1 AS others FROM embeddings WHERE vec_id % {fx.QUERY_EVERY} = 0)",
    "j1_exact_topk": f"WITH {C}, {S} SELECT * FROM (SELECT query_id, vec_id, score, CAST({RANKED} AS INTEGER) AS rank FROM scored) WHERE rank <= 10",
    "j1_exact_topk_filtered": f"WITH {C}, {S} SELECT * FROM (SELECT query_id, vec_id, score, CAST({RANKED} AS INTEGER) AS rank FROM scored WHERE chunk_type = 'text' AND page_number <= 4) WHERE rank <= 10",
    "j2_single_topk": f"WITH {C}, q AS (SELECT list_transform(range(0, 64), lambda i: ((i * 37) % 11 - 5) / 10.0::DOUBLE) AS v) SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(v, v))), 6) AS score FROM chunks, q ORDER BY score DESC, vec_id LIMIT 10",
    "j4_bm25": BM25_SQL,
    "j4_stored_index": BM25_SQL,
    "j5_page_overfetch": f"WITH {HINTED_SQL} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank, intent FROM within",
    "j6_intent_boost": f"WITH {HINTED_SQL} SELECT query_id, vec_id, score2 AS score, CAST(rank2 AS INTEGER) AS rank, intent FROM boosted",
    "j7_rank_fusion": f"WITH {FUSED_SQL} SELECT * FROM fused",
    "j8_rerank": f"WITH {FUSED_SQL} SELECT * FROM (SELECT query_id, vec_id, score2 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC, rank, vec_id) AS INTEGER) AS rank FROM (SELECT *, round(0.3::DOUBLE * score + 0.7::DOUBLE * (1 / CAST(1 + vec_id % 7 AS DOUBLE)), 6) AS score2 FROM fused)) WHERE rank <= 5",
    "j9_retrieve": RETRIEVED_SQL,
    "j10_no_results": f"WITH {C}, {S} SELECT vec_id AS query_id, 'no_documents' AS status FROM embeddings WHERE vec_id % {fx.QUERY_EVERY} = 0 AND vec_id NOT IN (SELECT query_id FROM scored WHERE score >= 0.45)",
    "j11_chunk_by_id": f"WITH {C} SELECT {', '.join(SHOWN)}, content FROM chunks WHERE chunk_id = '7_3'",
    "f6_threshold": f"WITH {C}, {S} SELECT * FROM (SELECT query_id, vec_id, score, CAST({RANKED} AS INTEGER) AS rank FROM scored) WHERE rank <= 10 AND score >= 0.3",
    "e3_normalise": f"WITH {C}, u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3.0) AS v FROM chunks), w AS (SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 5)) AS v FROM u) SELECT vec_id, round(list_inner_product(v, v), 3) AS squares, CAST(len(v) AS INTEGER) AS n FROM w",
    "e4_dimension": "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'dimension 60, expected 64' END AS reason FROM embeddings",
    **{n: f"WITH {C} SELECT {', '.join(SHOWN)} FROM chunks WHERE {w}" for n, (_, w) in FILTERS.items()},
    **{n: f"WITH {JUDGED_SQL} SELECT query_id, {', '.join(c)} FROM judged" for n, c in METRICS.items()},
}
