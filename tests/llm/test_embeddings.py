import math

import numpy as np
from docquery.llm import embeddings


def brute(rows):
    """rows: (vec_id, vector); exact links of all pairs, ids not null and distinct."""
    good = [(d, np.array(v, float)) for d, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = {d: 0 for d, _ in rows}, {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = 0
    for dim in {len(v) for _, v in good}:
        own = [(d, v / np.linalg.norm(v)) for d, v in good if len(v) == dim]
        m = np.array([v for _, v in own])
        for i, j in zip(*np.nonzero(np.triu(m @ m.T >= 0.95, 1)), strict=True):
            a, b = own[i][0], own[j][0]
            pairs += 1
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (links[d], find(d)) for d in links}, pairs


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((1500, 64))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.97, (1500, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * noise
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    want, pairs = brute(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[d].n_links <= n for d, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) / 2 >= 0.9 * pairs


def test_given_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, pairs = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.query(spark, sf).collect()}
    assert sum(n for n, _ in got.values()) >= 0.97 * 2 * pairs and len(got) == len(rows)
    assert sum(got[d] != want[d] for d in want) <= 0.02 * len(rows)


def test_hot_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre * (1 + i % 7)).tolist()) for i in range(40)]  # copies and multiples
    rows += [(100 + i, (centre + 0.02 * rng.standard_normal(16)).tolist()) for i in range(300)]
    rows += [(500, None), (501, [0.0] * 16), (502, [1.0, None] + [0.0] * 14), (503, [math.nan] + [1.0] * 15), (504, [math.inf] + [0.0] * 15), (505, []), (506, [1e300] * 16), (507, [1e-300] * 16), (508, centre[:8].tolist())]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, kept string")
    want, _ = brute([r for r in rows if r[0] not in (506, 507)])
    want |= {506: (1, 506), 507: (1, 506)}
    block, embeddings.links.__defaults__ = embeddings.links.__defaults__, (0.95, 50)
    try:
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    finally:
        embeddings.links.__defaults__ = block
    assert {d: x[:2] for d, x in got.items()} == want
    assert all(k == (d == c) for d, (_, c, k) in got.items())


def test_repeated_rows_and_null_ids(spark):
    v = [1.0] * 4
    frame = spark.createDataFrame([(1, v), (1, v), (None, v), (None, None), (3, [1.0, -1.0, 1.0, -1.0])], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=repr)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
