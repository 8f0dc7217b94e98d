"""The whole retrieval of a batch of questions, composed of the operators: one frame in, one ranked frame out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.config import DEFAULTS
from docquery.operators import conversation, intents, search
from docquery.operators.filters import apply_filters
from docquery.sources.storage import stored


def enhanced(asked: DataFrame) -> DataFrame:
    """Adds to questions (query_id, question, prior_turns, last_user, rewrite: a model's answer or null) intent, page_filter, boost and enhanced: what is searched for.

    A question is rewritten where the conversation is long enough and it points back;
    its intent is that of the original; the terms of the intent and a prefix with the
    last user turn come on top.
    """
    gate = conversation.rewrite_gate(F.col("prior_turns"), F.col("question"))
    alone = F.when(gate, conversation.rewritten(F.col("rewrite"), F.col("question"))).otherwise(F.col("question"))
    known = asked.withColumns({"__alone": alone, "intent": intents.classify(F.col("question"))}).join(F.broadcast(intents.rules(asked.sparkSession)), "intent")
    expanded = F.concat_ws(" ", "__alone", "terms")
    return known.withColumn("enhanced", conversation.with_context_prefix(expanded, F.col("last_user"))).drop("__alone", "terms", "confidence")


def retrieve(
    chunks: DataFrame,
    asked: DataFrame,
    vector_of: Callable[[Column], Column],
    scorer: Callable[[Column, Column], Column] | None = None,
    *,
    filters: Mapping[str, Any] | None = None,
    hybrid: bool = True,
    fetch: int = DEFAULTS.retrieve_k,
    k: int = DEFAULTS.return_k,
    threshold: float = DEFAULTS.score_threshold,
    alpha: float = DEFAULTS.alpha,
) -> DataFrame:
    """Questions (see ``enhanced``) to (query_id, vec_id, score, rank) of ``chunks`` (vec_id, page_number, content, embedding and what ``filters`` name).

    Vector search under the filters, twice as many results where an intent prefers
    pages, the threshold, the boost of those pages, keyword search under the same
    filters, rank fusion, and reranking by ``scorer`` (question, content). Questions
    that find nothing have no rows: ``search.without_results`` names them.
    """
    own = apply_filters(chunks, filters)
    ready = enhanced(asked)
    vectors = ready.select("query_id", vector_of(F.col("enhanced")).alias("query_vector"))
    # the best of each question are few rows: files, so that Spark joins the chunks to them without a shuffle while they are small
    ranked = stored(search.top_k(own, vectors, 2 * fetch, threshold=threshold, skip_same_id=False), "ranked")
    ranked = ranked.join(ready.select("query_id", "page_filter", "boost"), "query_id").join(own.select("vec_id", "page_number"), "vec_id")
    ranked = search.boosted(search.within_k(ranked, fetch)).select("query_id", "vec_id", "score", "rank")
    if hybrid:
        words = ready.select("query_id", F.col("enhanced").alias("question"))
        ranked = search.fused(ranked, search.bm25(own, words, fetch, doc_id="vec_id", text="content"), alpha=alpha)
    if scorer is None:
        return search.reranked(ranked, None, k)
    texts = stored(ranked, "fused").join(own.select("vec_id", "content"), "vec_id").join(asked.select("query_id", "question"), "query_id")
    return search.reranked(texts, scorer(F.col("question"), F.col("content")), k).select("query_id", "vec_id", "score", "rank")
