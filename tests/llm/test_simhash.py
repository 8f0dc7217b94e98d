import numpy as np
import xxhash
from docquery.llm import simhash
from pyspark.sql import functions as F


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp). The smallest id that each fingerprint reaches."""
    fps = sorted({fp for _, fp in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    least = {}
    for d, fp in rows:
        r = find(fp)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fp:016x}", least[find(fp)]) for d, fp in rows), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in simhash.query(spark, sf_dir).collect()), key=repr)
    assert got == brute_components(rows)


def test_planted_bits_and_chains():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = [base]
    for _ in range(3):  # chains of steps of one or two bits
        flips.append(flips[-1] ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    dense = np.uint64(12345) ^ np.unique((np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)))
    fps = np.unique(np.concatenate([*flips, dense]))
    up = simhash.link(fps, 2, np.random.default_rng(1))
    whole = np.arange(len(fps))
    for at in range(0, len(fps), 500):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None, :]) <= 2)
        whole = simhash.hook(whole, i + at, j)
    assert np.array_equal(up, whole)


def test_sharded_links_equal_one_shard(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near])).view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    rows = [(i, int(np.uint64(x.view(np.uint64)))) for i, x in enumerate(fps)]
    from docquery.llm.components import components

    for leaf in (100, 100_000):
        edges = simhash.linked(frame, leaf=leaf, sample=1500)
        roots = {r.v: r.root for r in components(edges).collect()}
        groups = {}
        for i, x in enumerate(fps.tolist()):
            groups.setdefault(roots.get(x, x), []).append(i)
        want = {}
        for d, _, c in brute_components(rows):
            want.setdefault(c, []).append(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "one two", "x"), (5, "ONE two", "x"), (5, "ONE two", "x"), (6, "word " * 50_000, "x"), (None, "alone here now then", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 5), (5, 5), (6, 6), (None, None)}
    kept = sorted((r.doc_id or -1) for r in simhash.keep_one(docs).collect())
    assert kept == [-1, 1, 5, 6]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.filter(F.lit(False))).count() == 0
