import corpus_pipeline
import numpy as np
from docquery.llm import jaccard, simhash
from docquery.llm.common import parted
from docquery.llm.components import components
from docquery.sources.storage import shared_folder
from pyspark.sql import functions as F


def brute_set(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """rows: (doc_id, text). The smallest id of each class at a similarity of 0.8."""
    sets, up = [(d, brute_set(t)) for d, t in sorted(rows)], {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                up[high] = low
    return sorted({find(d) for d, _ in sets})


def planted():
    """Texts of 200 words with copies of similarity 0.8 to 0.95, and copies under 0.8."""
    rng, rows = np.random.default_rng(2), []
    for g in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((10 * g, " ".join(base)))
        for c, edits in enumerate((1, 2, 3, 4, 9), 1):
            copy = list(base)
            for at in rng.choice(np.arange(5, 195, 10), edits, replace=False):
                copy[at] = f"new{g}x{c}"
            rows.append((10 * g + c, " ".join(copy)))
    return rows


def test_stage_keeps_one_of_planted_copies(spark):
    rows = planted()
    want = brute_kept(rows)
    assert len(want) < len(rows) / 2 and any(d % 10 == 5 for d in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_blocks_and_frequent_shingles_change_nothing(spark, monkeypatch):
    rows = [(d, "the same opening of every single text here " * 2 + t) for d, t in planted()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == want


def test_given_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(r.doc_id for r in jaccard.keep_one(docs).collect())
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_long_lists_are_joined_whole(spark):
    base = [f"w{x}" for x in range(200)]
    rows = [(c, " ".join(f"new{c}" if at == 5 + 2 * c else w for at, w in enumerate(base))) for c in range(90)]
    assert [r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "one two"), (5, "ONE two"), (5, "ONE two"), (6, "word " * 50_000), (None, "alone here now then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in jaccard.keep_one(docs).collect()) == [-1, 1, 5, 6]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_stage_goes_through_the_tree(spark, monkeypatch):
    """The tree gets fingerprints of all sets, links are checked by whole sets, and prefixes join only what it leaves apart."""
    base = [f"w{x}" for x in range(3000)]
    near = [(c, " ".join(f"new{c}" if at == 100 * c else w for at, w in enumerate(base))) for c in range(12)]
    rows = near + [(100 + d, t) for d, t in planted()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, linked = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda fps: seen.append((fps.count(), linked(fps).count())) or linked(fps))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_kept(rows)
    assert len(seen) == 1 and seen[0][0] > 150 and seen[0][1] > 0
    # a tree that links everything changes no result
    monkeypatch.setattr(simhash, "linked", lambda fps: fps.selectExpr("fp as a", "min(fp) over () as b"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_kept(rows)


def test_keys_as_bits(spark):
    rows = spark.range(200_000).withColumn("k", F.xxhash64("id"))
    keys = rows.filter("id % 20 = 0").select("k")
    may, others = parted(rows, F.col("k"), keys)
    found = {r.id for r in may.select("id").collect()}
    assert found.isdisjoint(left := {r.id for r in others.select("id").collect()}) and len(found) + len(left) == 200_000
    assert {*range(0, 200_000, 20)} <= found and len(found) < 10_000 + 190_000 / 8
    assert parted(rows, F.col("k"), keys.limit(0))[0].isEmpty()


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    """All that the stage shuffles is less than its texts, and nothing is left of its steps."""
    rng = np.random.default_rng(3)
    rows = [(d, " ".join(f"{x:x}" for x in rng.integers(1 << 28, 1 << 32, 2000))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_frequent", lambda texts, k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(20_000)
        found = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().executorList(False))
        return sum(x.totalShuffleWrite() for x in found)

    before = shuffled()
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 200
    assert corpus_pipeline.near_duplicates(spark, docs, "").agg(F.sum(F.length("text"))).head()[0] == sum(len(t) for _, t in rows)
    assert (shuffled() - before) / 2 < 0.8 * sum(len(t) for _, t in rows)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/*/steps")
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)


def test_no_table_of_the_graph_is_broadcast(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    found = components(edges)
    assert len({r.root for r in found.collect()}) == 1
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
