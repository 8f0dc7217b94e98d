"""Writes to the chunk store, the model hook, and quantile sketches."""

import os

import numpy as np
import pytest
from docquery.functions.loaded import Loaded
from docquery.operators import catalogue, embed, telemetry
from docquery.sources import fixtures as fx
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, document_id string, content string, created_at int, department string"
ROWS = [(f"{d}{k}", f"doc{d}{k % 3}", "old", 1, d) for d in "abc" for k in range(6)] + [("n0", "docn", "old", 1, None)]


@pytest.fixture()
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    catalogue.write_store(spark.createDataFrame(ROWS, SCHEMA), path)
    return path


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def rows(spark, path):
    return {r.chunk_id: (r.content, r.department) for r in spark.read.parquet(path).collect()}


def test_upsert_writes_touched_departments_alone(spark, store):
    before = files(store)
    new = spark.createDataFrame([("a1", "doca1", "new", 2, "a"), ("b2", "docb2", "moved", 2, "c"), ("c0", "docc0", "stale", 0, "c"), ("d0", "docd0", "first", 1, "d")], SCHEMA)
    assert catalogue.upsert_store(new, store) == ["a", "b", "c", "d"]
    got = rows(spark, store)
    assert len(got) == len(ROWS) + 1 and got["a1"] == ("new", "a") and got["b2"] == ("moved", "c") and got["c0"] == ("old", "c") and got["d0"] == ("first", "d")
    one = spark.createDataFrame([("a1", "doca1", "newer", 3, "a")], SCHEMA)
    between = files(store)
    assert catalogue.upsert_store(one, store) == ["a"]
    after = files(store)
    kept = {f: t for f, t in between.items() if "department=a" not in f}
    assert kept and all(after[f] == t for f, t in kept.items()) and not any(f in after for f in between if "department=a" in f)
    assert rows(spark, store)["a1"][0] == "newer" and set(before) != set(after)


def test_delete_also_empties_departments(spark, store):
    gone = spark.createDataFrame([("doca0",), ("docb0",), ("docb1",), ("docb2",), ("docn",), ("unknown",)], "document_id string")
    before = files(store)
    assert catalogue.delete_from_store(spark, gone, store) == [None, "a", "b"]
    got = rows(spark, store)
    assert {d for _, d in got.values()} == {"a", "c"} and len(got) == 4 + 6
    assert all(files(store)[f] == t for f, t in before.items() if "department=c" in f)
    assert catalogue.delete_from_store(spark, spark.createDataFrame([("unknown",)], "document_id string"), store) == []


def test_a_failed_write_leaves_the_old_store(spark, store):
    before = rows(spark, store)
    new = spark.createDataFrame([("a1", "doca1", "new", 2, "a"), ("a2", "doca2", None, 2, "a")], SCHEMA)
    broken = new.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        catalogue.upsert_store(broken, store)
    assert rows(spark, store) == before


class Stub:
    """Counts its loads and the sizes of its batches in a file."""

    def __init__(self, log):
        self.log = log
        self.note("load")

    def note(self, what):
        with open(self.log, "a") as f:
            f.write(f"{os.getpid()} {what}\n")

    def __call__(self, texts):
        self.note(len(texts))
        return np.array([[len(t), 1.0] for t in texts])


def test_a_model_is_loaded_once_a_worker_and_batched(spark, tmp_path):
    log = str(tmp_path / "log")
    model = Loaded(lambda: Stub(log))
    texts = [None if k % 50 == 3 else "x" * (k % 90) for k in range(1000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, `a.text` string").repartition(8)
    for out in (embed.embedded(frame, model, text="a.text", batch=32), frame.withColumn("embedding", embed.model_vectors(model, 32)(F.col("`a.text`")))):
        got = {r.id: r.embedding for r in out.collect()}
        assert got == {k: None if t is None else [len(t), 1.0] for k, t in enumerate(texts)}
    notes = [x.split() for x in open(log).read().splitlines()]
    loads, sizes = [p for p, n in notes if n == "load"], [int(n) for _, n in notes if n != "load"]
    assert len(loads) == len(set(loads)) and max(sizes) == 32 and sum(sizes) == 2 * 980
    bad = Loaded(lambda: lambda texts: np.zeros((1, 2)))
    with pytest.raises(Exception, match="the model gave"):
        embed.embedded(frame, bad, text="a.text").collect()


def test_the_stand_in_model_equals_the_column_function(spark):
    texts = ["", "a b", "Words, words and more_words 12", "Éléphant naïve 漢字 漢字", None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    model = Loaded(lambda: embed.HashedModel(16))
    both = embed.embedded(frame, model).join(frame.select("k", embed.hashed_vector(F.col("text"), 16).alias("v")), "k").collect()
    assert {r.k: r.embedding for r in both if r.k < 4} == {r.k: pytest.approx(r.v) for r in both if r.k < 4} and len(both) == 5


def test_sketches_of_days_merge_within_their_bound(spark):
    log = spark.range(60_000).select(F.lit("GET").alias("method"), (F.col("id") % 2).cast("string").alias("endpoint"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, id div 50)").alias("asked_at"), F.pow(F.rand(5), 3).alias("latency_ms"))
    sketches = telemetry.duration_sketches(log)
    assert sketches.select("span").distinct().count() == 50
    exact = {e: np.sort([r.latency_ms for r in log.filter(F.col("endpoint") == e).collect()]) for e in "01"}
    for r in telemetry.duration_quantiles(sketches).collect():
        assert r.observations == len(exact[r.endpoint])
        assert abs(np.searchsorted(exact[r.endpoint], r.latency_ms) / r.observations - r.quantile) < 0.01
    assert fx.requests(spark, "/root/testdata/sf0.001").count()
