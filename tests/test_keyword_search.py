"""Keyword search against a brute-force version; no pairs of queries and documents are shuffled or stored."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
from docquery.operators import embed, keyword_index, search
from docquery.plans import search_plans
from docquery.sources.storage import shared_folder
from docquery.sources.tables import table

SF = "/root/testdata/sf0.01"


def brute(docs, queries, k):
    held = defaultdict(Counter)  # rows of one id and length are one
    for d, text in docs:
        words = (text or "").lower().split()
        held[d, len(words)].update(words)
    mean, df = sum(len((t or "").split()) for _, t in docs) / len(docs), Counter(w for ws in held.values() for w in ws)
    out = []
    for q, question in queries:
        scores = Counter()
        for (d, n), ws in held.items():
            for w in set((question or "").lower().split()) & set(ws):
                scores[d] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * ws[w] * 2.2 / (ws[w] + 1.2 * (0.25 + 0.75 * n / mean))
        best = sorted((-round(s, 6), -math.inf if d is None else d, d) for d, s in scores.items())[:k]
        out += [(q, d, -s, r) for r, (s, _, d) in enumerate(best, 1)]
    return sorted(map(str, out))


def given():
    rng = random.Random(3)
    words = [f"w{round(1.3**x)}" for x in range(30)]
    text = lambda n: " ".join(rng.choices(words, range(30, 0, -1), k=n))
    docs = [(d, text(rng.randint(1, 40))) for d in range(300)]
    docs += [(7, docs[7][1]), (7, docs[8][1]), (None, "w1 w2"), (None, "w2"), (400, None), (401, ""), *((d, docs[0][1]) for d in range(500, 530))]
    return docs, [(q, text(rng.randint(1, 8))) for q in range(20)] + [(90, "nowhere"), (91, None)]


def test_equals_brute_force_in_one_or_many_passes(spark, monkeypatch):
    docs, queries = given()
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, question string")
    want = brute(docs, queries, 12)
    found = lambda: sorted(str(tuple(r)) for r in search.bm25(*frames, 12).collect())
    assert found() == want
    monkeypatch.setattr(search, "QUERIES", 4)
    monkeypatch.setattr(search, "SCORES", 1)
    assert found() == want


def test_no_pairs_of_queries_and_documents(spark):
    docs, queries = given()
    plan = search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, question string"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert search.bm25(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, question string"), 5).count() == 0


def _stored(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_retrieval_stores_less_than_the_documents(spark):
    before = _stored(spark)
    assert search_plans.retrieved_pipeline(spark, SF).count() > 0
    assert _stored(spark) - before < os.path.getsize(f"{SF}/documents.parquet")


def test_index_stores_no_words_and_shuffles_no_pairs(spark, tmp_path, monkeypatch):
    docs, queries = given()
    docs = [(d, t) for d, t in {d: (d, t) for d, t in docs}.values() if d is not None]
    path, before = str(tmp_path / "i"), _stored(spark)
    keyword_index.append(table(spark, SF, "documents"), str(tmp_path / "whole"))
    assert _stored(spark) == before
    keyword_index.append(spark.createDataFrame(docs, "doc_id long, text string"), path)
    asked = spark.createDataFrame(queries, "query_id long, question string")
    monkeypatch.setattr(keyword_index, "GROUP", 100)
    monkeypatch.setattr(keyword_index, "PACKED", 50)
    got = keyword_index.search(spark, path, asked, 12)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs, queries, 12)


def test_blocks_of_any_kind_find_the_same(monkeypatch):
    """Rare terms at once, middle ones on their own, frequent ones as matrices; single precision first: all as the plain sum."""
    rng = np.random.default_rng(4)
    n, words, queries = 3000, 400, 60
    tf = (rng.random((n, words)) < 1 / (1 + np.arange(words))).astype(int) * rng.integers(1, 4, (n, words))
    length, idf = tf.sum(axis=1) + 1, np.log(1 + (n - (tf > 0).sum(axis=0) + 0.5) / ((tf > 0).sum(axis=0) + 0.5))
    asks = rng.random((queries, words)) < 0.05
    of, term = np.nonzero(asks)
    weight = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[:, None] / length.mean()))
    scores = np.round(asks.astype(float) @ weight.T, 6)
    want = [(q, d, s) for q in range(queries) for s, d in sorted((-s, d) for d, s in enumerate(scores[q].tolist()) if s > 0)[:5]]
    for few in (0, 1 << 30, search.FEW_PAIRS):
        monkeypatch.setattr(search, "FEW_PAIRS", few)
        monkeypatch.setattr(search, "SCORES", 1 << 14)
        own = search.Keywords(np.arange(queries), np.append(term, term[:99]), np.append(of, of[:99]), idf, float(length.mean()), 5, 1.2, 0.75)
        for at in range(0, n, 500):
            d, t = np.nonzero(tf[at : at + 500])
            own.add(d + at, t, tf[d + at, t], length[d + at])
        out = own.out()
        got = list(zip(*(c.to_pylist() for c in out.columns), strict=True))
        assert [(q, d) for q, d, _ in got] == [(q, d) for q, d, _ in want]
        assert np.allclose([s for *_, s in got], [-s for *_, s in want], atol=2e-6)


def test_single_precision_misses_no_near_row(spark):
    """Scores that differ by a millionth, ties among them, over several blocks."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(i, (base + 2e-3 * rng.normal(size=64)).tolist()) for i in range(5000)] + [(5000 + i, base.tolist()) for i in range(8)]
    found = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(3, rows[3][1]), (9000, base.tolist())], "query_id long, query_vector array<double>"), 20).collect()
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for q, own in ((3, v[3]), (9000, v[5000])):
        s = np.round(v @ own, 6)
        want = [i for _, i in sorted((-x, i) for i, x in enumerate(s.tolist()) if i != q)[:20]]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == want


def test_a_word_is_hashed_once(monkeypatch):
    calls, md5 = [], embed.hashlib.md5
    monkeypatch.setattr(embed.hashlib, "md5", lambda w: calls.append(w) or md5(w))
    model = embed.HashedModel(16)
    made = model(["one two Two", "", "two_ words one", "x"])
    model(["words two"])
    assert sorted(calls) == [b"one", b"two", b"two_", b"words"]
    assert np.allclose((made**2).sum(axis=1), [1, 0, 1, 0])


def test_a_question_is_not_that_of_another_turn_of_its_id(spark, tmp_path):
    rows = [(50, 2, "user", "of fifty"), (49, 102, "user", "of another")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = search_plans.asked(spark, str(tmp_path)).collect()
    assert [(r.query_id, r.question.endswith("of fifty")) for r in found] == [(5002, True)]
