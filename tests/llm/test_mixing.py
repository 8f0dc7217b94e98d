from collections import Counter, defaultdict

import pytest
from docquery.llm import mixing


def targets(sizes):
    """Water filling, one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    cap, full, rest = {s: 3 * n for s, n in sizes.items()}, {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] >= cap[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = float(cap[s])
            rest -= cap[s]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 900, None: 10}, {"a": 5, "b": 5, "c": 1000, "d": 7, "ä": 50}, {"x": 0, "y": 10}, {"only": 12}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_taken_words(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.01").collect()
    taken, target, largest = Counter(), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert target == pytest.approx(targets({s: sum(r.size for r in rows if r.source == s) for s in target}))
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in target.items())
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.query(spark, "/root/testdata/sf0.01").collect()))


def test_mixture_is_the_plan_in_queue_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter({r.doc_id: r.copies for r in mixing.plan(docs).collect() if r.copies})
    out = mixing.mix(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == want


def test_edge_cases(spark):
    rows = [(1, "a", "one two three"), (1, "a", "one two three"), (None, None, "x y"), (2, "a", None), (3, "b", ""), (4, "b", "w " * 50_000), (5, None, " \n")]
    frame = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, source string, text string, size string, copies int")
    got = {(r.doc_id, r.source): (r.size, r.taken) for r in mixing.plan(frame).withColumn("taken", mixing.F.col("size") * mixing.F.col("copies")).collect()}
    assert got[2, "a"] == (0, 0) and got[3, "b"] == (0, 0) and got[1, "a"] == (3, 9) and got[None, None] == (2, 6) and got[4, "b"][1] == 50_000
    assert mixing.mix(frame).columns == frame.columns and mixing.mix(frame).filter("doc_id = 1").count() == 6
    assert mixing.plan(frame.limit(0)).count() == 0 and mixing.mix(frame.limit(0)).count() == 0
