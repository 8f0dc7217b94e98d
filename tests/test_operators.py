"""Hand values and rules of single operators."""

import pytest
from docquery.operators import conversation, filters, intents, metrics, search
from docquery.sources import fixtures as fx
from pyspark.sql import functions as F


def test_ranking_hand_values(spark):
    rows = {1: (["d1", "d2", "d3", "d4", "d5"], ["d1", "d3", "d5"]), 2: ([], ["d1"]), 3: (["d2", "d3", "d1"], ["d1"]), 4: (["d1", "d2"], []), 5: (["d3", "d1", "d4", "d2"], ["d1", "d2"])}
    q = spark.createDataFrame([(i,) for i in rows], "query_id long")
    retrieved = spark.createDataFrame([(i, n + 1, d) for i, (r, _) in rows.items() for n, d in enumerate(r)], "query_id long, rank int, id string")
    relevant = spark.createDataFrame([(i, d) for i, (_, r) in rows.items() for d in r], "query_id long, id string")
    got = {r.query_id: r for r in metrics.ranking(q, retrieved, relevant, 5).collect()}
    assert got[1].precision == 0.6 and got[2].precision == 0 and got[2].context_precision == 1
    assert got[3].mrr == pytest.approx(1 / 3, abs=1e-6) and got[1].mrr == 1 and got[2].mrr == 0
    assert got[4].recall == 1 and got[4].context_recall == 1 and 0 < got[5].ndcg < 1
    k3 = {r.query_id: r for r in metrics.ranking(q, retrieved, relevant, 3).collect()}
    assert k3[1].recall == pytest.approx(2 / 3, abs=1e-6)


def test_capital_i_never_matches_by_default(spark):
    df = spark.createDataFrame([("How do I submit it",), ("When will I receive it",), ("who to contact",), ("what is this document about",)], "question string")
    assert [r[0] for r in df.select(intents.classify(F.col("question"))).collect()] == ["general", "general", "contact", "definition"]
    assert [r[0] for r in df.select(intents.classify(F.col("question"), True)).collect()][:2] == ["procedure", "deadline"]


def test_filters(spark):
    assert filters.compile_filters({}) is None and filters.compile_filters({"a": "", "b": None, "c": ["", None]}) is None
    with pytest.raises(ValueError):
        filters.compile_filters({"a": {"$near": 1}})
    df = fx.chunks(spark, "/root/testdata/sf0.001")
    plan = filters.apply_filters(df, {"label": {"$gte": 3}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(label,3)" in plan


def test_fusion_with_an_empty_side_keeps_the_order(spark):
    v = spark.createDataFrame([(1, i, i + 1) for i in range(9)], "query_id long, vec_id long, rank int")
    got = search.fused(v, search.no_keyword_hits(v.select("query_id").distinct())).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(9)) and got[0].score == pytest.approx(0.5 / 61)


def test_approximate_search_has_recall(spark):
    sf = "/root/testdata/sf0.01"
    chunks, queries = fx.chunks(spark, sf), fx.vector_queries(spark, sf)
    exact = {(r.query_id, r.vec_id) for r in search.top_k(chunks, queries, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in search.approximate_top_k(chunks, queries, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    again = search.approximate_top_k(chunks, queries, 10, index=search.sketches(chunks))
    assert {(r.query_id, r.vec_id) for r in again.collect()} == near


def test_top_k_in_blocks_is_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    chunks, queries = fx.chunks(spark, sf), fx.vector_queries(spark, sf)
    whole = sorted(map(tuple, search.top_k(chunks, queries, 7).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 3 * 64 * 8)
    assert sorted(map(tuple, search.top_k(chunks, queries, 7).collect())) == whole


def test_text_metrics(spark):
    df = spark.createDataFrame([("the cat sat on the mat today", "the cat sat on the mat today"), ("the cat sat on a mat", "a dog ran"), ("", "x")], "r string, h string")
    got = df.select(metrics.bleu(F.col("r"), F.col("h")).alias("b"), metrics.rouge_n(F.col("r"), F.col("h"), 1).alias("r1"), metrics.rouge_l(F.col("r"), F.col("h")).alias("rl"), metrics.similarity(F.col("r"), F.col("h")).alias("s")).collect()
    assert got[0].b == pytest.approx(1) and got[0].r1 == 1 and got[0].rl == 1 and got[0].s == pytest.approx(1)
    assert 0 < got[1].b < 0.3 and got[1].rl == pytest.approx(2 / 9) and got[1].s == 0
    assert tuple(got[2]) == (0, 0, 0, 0)


def test_citations_and_hallucination(spark):
    df = spark.createDataFrame([("see [Source 1: guide.txt, Page 2] and [Source 2: other book]", "the guide.txt, Page 2 says 12"), ("made 99 of 98", "12 of 98")], "a string, c string")
    got = df.select(metrics.citation_accuracy(F.col("a"), F.col("c")).alias("cite"), metrics.hallucinated(F.col("a"), F.col("c")).alias("bad")).collect()
    assert got[0].cite == 0.5 and got[1].cite == 0 and got[1].bad


def test_prompt(spark):
    df = spark.createDataFrame([("hi", "ctx")], "q string, c string").withColumn("h", F.array(F.struct(F.lit("user").alias("role"), F.lit("old").alias("text"))))
    got = df.select(conversation.prompt_messages(F.col("h"), F.col("c"), F.col("q")).alias("m")).head().m
    assert [x.role for x in got] == ["system", "user", "user"] and got[2].content.endswith("QUESTION: hi\n\nANSWER:")


def test_cache_without_pairs(spark):
    """A hot key over many spans against brute force, and a plan that forms no pairs."""
    import datetime
    import random

    from docquery.operators import cache

    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    at = lambda: start + datetime.timedelta(seconds=rng.randrange(40_000))
    asked = [(i, rng.choice("aaaab"), at()) for i in range(800)] + [(900, None, start), (901, "a", None)]
    entries = [(rng.choice("aaab"), at(), i) for i in range(120)]
    voids = [(at(),) for _ in range(40)]
    a = spark.createDataFrame(asked, "request_id long, key string, asked_at timestamp")
    e = spark.createDataFrame(entries, "key string, cached_at timestamp, response long")
    v = spark.createDataFrame(voids, "at timestamp")
    found = cache.lookup(a, e, 3600, v)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, key, t in asked:
        live = [(c, r) for k, c, r in entries if key is not None and t is not None and k == key and c <= t < c + datetime.timedelta(seconds=3600) and not any(c < x <= t for (x,) in voids)]
        want[i] = max(live) if live else (None, None)
    assert {r.request_id: (r.cached_at, r.response) for r in found.collect()} == want


def test_ranking_by_label_is_ranking(spark):
    items = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label int")
    queries = spark.createDataFrame([(0, 0), (1, 1), (40, 2), (41, None)], "query_id long, label int")
    retrieved = spark.createDataFrame([(q, r + 1, (q + 2 * r) % 30) for q in (0, 1, 40) for r in range(6)], "query_id long, rank int, id long")
    relevant = queries.join(items, "label").filter("query_id <> id").select("query_id", "id")
    assert sorted(map(tuple, metrics.ranking_by_label(queries, retrieved, items).collect())) == sorted(map(tuple, metrics.ranking(queries, retrieved, relevant).collect()))


def test_longest_common_subsequence():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(50):
        r, h = [[rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2)]
        want = max(n for n in range(len(r) + 1) if any(all(c in it for c in part) for part in itertools.combinations(r, n) for it in [iter(h)]))
        assert metrics._longest_common(r, h) == want


def test_words_of_a_whole_batch_are_never_python_objects_at_once():
    import tracemalloc

    import pyarrow as pa
    from docquery.operators import metrics

    words = pa.array([[f"w{i}x{j}" for j in range(60)] for i in range(6000)])
    for score in (metrics._bleus, metrics._lcs):
        tracemalloc.start()
        score.func(words, words)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5_000_000


def test_exact_search_holds_small_blocks(spark, monkeypatch):
    rows = [(k, [float((k * 37 + i * i) % 101) - 50 for i in range(8)]) for k in range(3000)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = chunks.selectExpr("vec_id as query_id", "embedding as query_vector")
    assert search.BLOCK_ROWS * search.BLOCK_QUERIES * 8 <= 2 << 20 and search.QUERY_BYTES <= 32 << 20
    whole = sorted(map(tuple, search.top_k(chunks, queries, 6).collect()))
    monkeypatch.setattr(search, "BLOCK_ROWS", 7000)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7000)
    assert sorted(map(tuple, search.top_k(chunks, queries, 6).collect())) == whole and len(whole) == 18000


def test_similarity_grows_no_faster_than_the_texts(spark):
    import time

    def seconds(n):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i)), " ")
        began = time.perf_counter()
        assert spark.range(1).select(metrics.similarity(F.concat(text, F.lit(" x")), text).alias("s"), metrics.grounding(text, text).alias("g")).head().s > 0.99
        return time.perf_counter() - began

    seconds(10)
    assert seconds(24000) < 6 * seconds(6000)


def test_text_metrics_are_those_of_plain_python(spark):
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(9)
    text = lambda: rng.choice([None, "", " . ", "the"]) if rng.random() < 0.15 else "".join(rng.choice(["ab ", "Cd ", "ef. ", "the ", "gh! ", "straße ", "x "]) for _ in range(rng.randrange(30)))
    rows = [(k, text(), text()) for k in range(2 * metrics.ROWS + 44)]

    def topics(t):
        return Counter(w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in metrics.stop_words())

    def cosine(x, y):
        norm = lambda a, b: math.sqrt(sum((n * (1 if w in b else math.log(1.5) + 1)) ** 2 for w, n in a.items()))
        return sum(n * y[w] for w, n in x.items()) / (norm(x, y) * norm(y, x)) if x and y else 0

    def bleu(r, h):
        grams = lambda t, n: Counter(zip(*[t[k:] for k in range(n)], strict=False))
        if not set(r) & set(h):
            return 0
        logs = sum(math.log(((grams(r, n) & grams(h, n)).total() or 0.1) / max(len(h) - n + 1, 1)) for n in range(1, 5))
        return (1 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(logs / 4)

    def rouge(r, h):
        table = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
        for i, x in enumerate(r):
            for j, y in enumerate(h):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 2 * table[-1][-1] / (len(r) + len(h)) if r and h else 0

    df = spark.createDataFrame(rows, "k long, a string, c string").coalesce(1)
    a, c = F.col("a"), F.col("c")
    got = df.select("*", metrics.similarity(a, c).alias("s"), metrics.grounding(a, c).alias("g"), metrics.faithfulness(a, c).alias("f"), metrics.bleu(c, a).alias("b"), metrics.rouge_l(c, a).alias("r")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.s == pytest.approx(cosine(topics(x.a), topics(x.c)))
        said = [t for t in re.split("[.!?]+", x.a or "") if t.strip()]
        want = None if x.a is None else sum(cosine(topics(t), topics(x.c)) >= 0.4 for t in said) / max(1, len(said))
        assert x.f == want and x.g.faithfulness == want
        assert x.g.hallucinated is (None if x.c is None and x.s >= 0.3 else x.s < 0.3)
        assert x.b == pytest.approx(bleu((x.c or "").lower().split(), (x.a or "").lower().split()))
        assert x.r == pytest.approx(rouge(re.findall("[a-z0-9]+", (x.c or "").lower()), re.findall("[a-z0-9]+", (x.a or "").lower())))
