import zlib
from collections import Counter

from docquery.llm import sharding


def check(rows, given, shards=24):
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in rows))) == sorted(map(repr, ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, _, t in given)))
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min([*per.values(), *([0] if len(per) < shards else [])]) <= 1 and set(per) <= set(range(shards))
    for s, n in per.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_law_and_proportions(spark):
    sf = "/root/testdata/sf0.01"
    given = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sharding.query(spark, sf).collect()
    check(rows, given)
    # every shard has of each source what its share says, give or take two
    whole, both = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    assert all(abs(both[s, x] - n / 24) <= 2 for s in range(24) for x, n in whole.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.query(spark, sf).collect()))


def test_against_brute_force(spark, sf_dir):
    import hashlib

    given = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    key = lambda d, s: hashlib.md5(f"shards-1:{d}:{s}".encode()).hexdigest()
    placed = []
    for source in {s for _, s in given}:
        own = sorted(((key(d, s), d) for d, s in given if s == source))
        placed += [((2 * i + 1) / (2 * len(own)), k, d) for i, (k, d) in enumerate(own)]
    placed.sort()
    n = len(placed)
    want = {d: p * 24 // n for p, (_, _, d) in enumerate(placed)}
    assert {r.doc_id: r.shard for r in sharding.query(spark, sf_dir).collect()} == want


def test_edge_cases(spark):
    given = [(1, "a", None), (1, "a", None), (None, None, ""), (2, None, "é" * 9), (3, "a", "x" * 300_000), *((i, "hot", "same") for i in range(10, 60))]
    frame = spark.createDataFrame([(*g, 7) for g in given], "doc_id long, source string, text string, shard int")
    check(sharding.interleave(frame).collect(), given)
    assert sharding.interleave(frame.limit(0)).count() == 0
