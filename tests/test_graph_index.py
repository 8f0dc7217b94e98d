"""The index of approximate search: recall, rows visited, appending, equal and odd vectors."""

import os

import numpy as np
import pytest
from docquery.operators import graph_index, search
from docquery.plans import search_plans
from docquery.sources import fixtures as fx
from pyspark.sql import functions as F

BIG = "/root/testdata/sf0.1"


def recall(got, want):
    near = {(r.query_id, r.vec_id) for r in got}
    return sum((r.query_id, r.vec_id) in near for r in want) / len(want)


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no data of that scale")
def test_recall_and_visited_share(spark, tmp_path):
    chunks, queries = fx.chunks(spark, BIG).select("vec_id", "embedding"), fx.vector_queries(spark, BIG)
    graph_index.write(chunks, str(tmp_path / "i"))
    index = graph_index.read(spark, str(tmp_path / "i"))
    want = search.top_k(chunks, queries, 10).collect()
    got = graph_index.search(index, queries, 10).collect()
    assert len(got) == len(want) and recall(got, want) >= 0.9
    assert np.mean([r.visited for r in got]) < 0.1 * chunks.count()
    exact = {(r.query_id, r.vec_id): r.score for r in want}
    assert all(exact.get((r.query_id, r.vec_id), r.score) == r.score for r in got)
    # queries that are no rows of the table need a wider beam on such unrelated vectors
    fresh = queries.select((-F.col("query_id") - 1).alias("query_id"), F.transform("query_vector", lambda x, i: x + F.sin(i * 7 + F.col("query_id")) / 8).alias("query_vector"))
    assert recall(graph_index.search(index, fresh, 10, beam=60).collect(), search.top_k(chunks, fresh, 10).collect()) >= 0.9


def test_parts_blocks_and_appending(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    rows = [(k, (centres[k % 30] + 0.3 * rng.standard_normal(16)).tolist()) for k in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = frame.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    graph_index.write(frame.filter("vec_id < 600"), str(tmp_path / "i"), part_rows=100)
    before = {f: os.path.getmtime(f) for d, _, fs in os.walk(tmp_path / "i") for f in (os.path.join(d, x) for x in fs)}
    graph_index.append(frame.filter("vec_id >= 600"), str(tmp_path / "i"), part_rows=100)
    assert all(os.path.getmtime(f) == t for f, t in before.items())
    index = graph_index.read(spark, str(tmp_path / "i"))
    assert index.select("generation").distinct().count() == 2 and index.select("part").distinct().count() == 6
    want = search.top_k(frame, queries, 5).collect()
    got = graph_index.search(index, queries, 5)
    monkeypatch.setattr(graph_index, "QUERY_BYTES", 1000)
    in_blocks = graph_index.search(index, queries, 5)
    assert recall(got.collect(), want) >= 0.95 and any(r.vec_id >= 600 for r in got.collect())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, in_blocks.collect()))
    graph_index.compacted(index, str(tmp_path / "one"), part_rows=2000)
    one = graph_index.read(spark, str(tmp_path / "one"))
    assert one.select("generation", "part").distinct().count() == 1 and recall(graph_index.search(one, queries, 5).collect(), want) >= 0.95


def test_equal_zero_and_odd_vectors(spark, tmp_path):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(300)] + [(1000 + k, [float(k), 1.0, -1.0]) for k in range(100)]
    rows += [(2000, [0.0, 0.0, 0.0]), (2001, None), (2002, []), (2003, [1.0, None, 2.0]), (2004, [float("nan"), 1.0, 1.0]), (2005, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph_index.write(frame, str(tmp_path / "i"))
    index = graph_index.read(spark, str(tmp_path / "i"))
    assert index.select(F.explode("ids")).count() == 402
    queries = spark.createDataFrame([(5, [1.0, 2.0, 3.0]), (1050, [50.0, 1.0, -1.0]), (7, None), (8, [1.0, 1.0, 1.0, 1.0]), (9, [2.0, 2.0])], "query_id long, query_vector array<double>")
    got = graph_index.search(index, queries, 4)
    assert {r.query_id: r.ids for r in got.groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).collect() if r.query_id != 1050} == {5: [0, 1, 2, 3], 9: [2005]}
    assert recall(got.filter("query_id = 1050").collect(), search.top_k(frame.filter("vec_id < 2000"), queries.filter("query_id = 1050"), 4).collect()) == 1
    assert graph_index.search(index.limit(0), queries, 4).count() == 0 and graph_index.search(index, queries.limit(0), 4).count() == 0


def test_every_node_is_reached():
    rng = np.random.default_rng(2)
    far_apart = np.concatenate([c + 0.001 * rng.standard_normal((40, 8)) for c in 5 * np.eye(8)])
    unit = far_apart / np.linalg.norm(far_apart, axis=1, keepdims=True)
    links, entries = graph_index.graph(unit)
    reached = np.zeros(len(unit), bool)
    graph_index._reach(links, entries, reached)
    assert reached.all()
    assert graph_index.graph(unit[:1])[1].tolist() == [0]


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no data of that scale")
def test_measured_beam_reaches_recall_over_generations(spark):
    assert tuple(search_plans.index_recall(spark, BIG).head()) == (40, 400, True)


def test_best_rows_of_nodes():
    """As row by row: nodes of many ids, ties in rounded scores, the query's own id, a threshold."""
    rng = np.random.default_rng(6)
    ends = np.append(0, np.cumsum(rng.integers(1, 9, 50)))
    ids = np.concatenate([np.sort(x) for x in np.split(rng.permutation(ends[-1]), ends[1:-1])])
    nodes = np.array([np.where(np.arange(20) < 20 - q % 5, rng.permutation(50)[:20], -1) for q in range(40)])
    scores = np.where(nodes >= 0, -np.sort(-rng.integers(0, 8, nodes.shape) / 8 - 1e-9, axis=1), -np.inf)
    for threshold, skip in ((None, True), (0.5, True), (None, False)):
        query, own, score = graph_index._best_ids(np.arange(40), scores, nodes, ends, ids, 4, threshold, skip)
        for q in range(40):
            rows = sorted((-round(s, 6), i) for s, n in zip(scores[q].tolist(), nodes[q].tolist(), strict=True) if n >= 0 for i in ids[ends[n] : ends[n + 1]].tolist() if not (skip and i == q))[:4]
            assert [(-s, i) for s, i in zip(score[query == q].tolist(), own[query == q].tolist(), strict=True)] == [r for r in rows if threshold is None or -r[0] >= threshold]


def test_some_beams_are_measured_in_one_reading(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 48)))], "vec_id long, embedding array<double>")
    graph_index.write(chunks, str(tmp_path / "index"))
    index, queries = graph_index.read(spark, str(tmp_path / "index")), spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 48)))], "query_id long, query_vector array<double>")
    monkeypatch.setattr(graph_index, "WHOLE", 0)
    calls, met = [], graph_index._met
    monkeypatch.setattr(graph_index, "_met", lambda index, queries, k, beams, *more: calls.append(beams) or met(index, queries, k, beams, *more))
    beam = graph_index.beam_for(index, queries, 10, recall=0.99)
    assert beam > 14 and calls == [[14, 28, 56, 112]]


def test_a_part_that_is_small_for_the_beam_is_compared_whole(spark, tmp_path):
    """Exactly what exact search finds, equal vectors and ties among it."""
    rng = np.random.default_rng(8)
    vectors = np.repeat(rng.normal(size=(200, 8)).round(1), 3, axis=0)
    chunks = spark.createDataFrame([(i * 7919 % 600, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    graph_index.write(chunks, str(tmp_path / "index"))
    queries = chunks.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    got = graph_index.search(graph_index.read(spark, str(tmp_path / "index")), queries, 10)
    assert {r.visited for r in got.collect()} == {len(np.unique(vectors, axis=0))}
    columns = ["query_id", "vec_id", "score", "rank"]
    assert sorted(got.select(columns).collect()) == sorted(search.top_k(chunks, queries, 10).select(columns).collect())
