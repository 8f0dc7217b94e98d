"""SimHash near-duplicates with vantage-point trees.

Fingerprints are computed text by text. Distinct fingerprints are then partitioned by
Hamming distance: a node of the tree has a vantage point and a radius, fingerprints
nearer than the radius go inside, the others outside. If two fingerprints differ in at
most r bits, the triangle bound says that their distances to the vantage point differ
by at most r; so it is enough that the inside also sends those within r of the radius
to the outside as visitors. Every leaf (a shard) then finds its pairs exactly.

The tree is fitted on a bounded sample of fingerprints and holds no more than
``LEAVES`` leaves; a task builds the rest of the tree inside its shard. The radius of
each node is where few fingerprints lie near the boundary, which keeps visitors few.
A leaf that holds more than is meant for it (many fingerprints close to each other,
which no radius parts) is dealt as pairs of hashed blocks, each pair a shard of its
own, so that no task gets more than two blocks. Shards report a spanning forest of what
they link, never all pairs. Nothing but the sample goes to the driver; texts are read
once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import jaccard
from docquery.llm.common import cut, documents
from docquery.llm.components import components

QUERY = "op9_simhash"
ORACLE_SQL = None
BITS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints that the tree is fitted on, at most; leaves of the tree, at most; fingerprints that a leaf is meant to hold.
SAMPLE, LEAVES, LEAF = 1 << 18, 8192, 8000
#: Inside a shard: a node of so few fingerprints is compared as a whole, in blocks of so many rows.
SMALL, BLOCK = 1024, 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if it is set in more than half of the XXH64 values of the word shingles, repeats included. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, len(words) - k + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in more than half of the values. No values: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # whole texts, some 4 MB at a time
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """Adds ``fp`` (the 64 bits as a signed long) to the other columns of ``docs``; ``text`` itself is left out."""
    kept = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                fps = np.fromiter((fingerprint(t, shingle) for t in part.column(part.num_columns - 1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept), "fp long"])
    return docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].cast("string").alias("__text")).mapInArrow(run, schema)


def distances(x: np.ndarray, y: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def radius(d: np.ndarray, r: int) -> int | None:
    """Where to part fingerprints at distances ``d``: least cost of the two sides, visitors counted on the outside. None: parting doesn't pay."""
    n = len(d)
    counts = np.bincount(d, minlength=66)[:66]
    below = np.concatenate(([0], np.cumsum(counts)))  # below[m]: distance < m
    m = np.arange(1, 65)
    inside = below[m]
    outside = n - inside + inside - below[np.maximum(m - r, 0)]
    cost = inside.astype(float) ** 2 + outside.astype(float) ** 2
    best = int(np.argmin(cost))
    return int(m[best]) if cost[best] < 0.9 * float(n) ** 2 and inside[best] else None


def grow(sample: np.ndarray, leaves: int, r: int, rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """The tree: nodes (vantage point, radius, inside, outside); a child below 0 is leaf -child - 1. The largest node is parted first."""
    import heapq

    nodes: list[list[int]] = []
    open_, done, tick = [(-len(sample), 0, sample, None)], [], 1
    while open_ and len(open_) + len(done) < leaves:
        _, _, own, at = heapq.heappop(open_)
        best = None
        for v in own[rng.integers(0, len(own), 6)] if len(own) > 64 else ():
            d = distances(own, v)
            if (m := radius(d, r)) is not None:
                larger = max((d < m).sum(), (d >= max(m - r, 0)).sum())
                if best is None or larger < best[0]:
                    best = larger, v, m, d
        if best is None:
            done.append(at)
            continue
        _, v, m, d = best
        k = len(nodes)
        nodes.append([int(v), m, 0, 0])
        if at is not None:
            nodes[at[0]][at[1]] = k
        for side, part in ((2, own[d < m]), (3, own[d >= m])):
            heapq.heappush(open_, (-len(part), tick, part, (k, side)))
            tick += 1
    for leaf, at in enumerate([*done, *(x[3] for x in open_)]):
        if at is not None:
            nodes[at[0]][at[1]] = -leaf - 1
    return [tuple(n) for n in nodes]


def visits(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home) of every leaf that each fingerprint goes to; home is where it would lie without visiting."""
    found, todo = [], [(0, np.arange(len(fps)), np.ones(len(fps), bool))] if nodes else []
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    while todo:
        k, own, home = todo.pop()
        if not len(own):
            continue
        if k < 0:
            found.append((own, np.full(len(own), -k - 1), home))
            continue
        v, m, inside, outside = nodes[k]
        d = distances(fps[own], np.uint64(v))
        near, far = d < m, d >= max(m - r, 0)
        todo += [(inside, own[near], home[near]), (outside, own[far], home[far] & (d[far] >= m))]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def roots_of(up: np.ndarray) -> np.ndarray:
    """Pointers followed to their end."""
    while not np.array_equal(further := up[up], up):
        up = further
    return up


def hook(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links a[k] - b[k]: larger roots are hooked to smaller ones until no link joins two roots."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        up = up.copy()
        up[np.maximum(x, y)] = np.minimum(x, y)
        up = roots_of(up)


def link(fps: np.ndarray, r: int, rng: np.random.Generator) -> np.ndarray:
    """Position of the root of each fingerprint: all that differ in at most ``r`` bits, directly or by steps, share one. The local part of the tree."""
    up, todo = np.arange(len(fps)), [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        best = None
        for v in fps[own[rng.integers(0, len(own), 6)]] if len(own) > SMALL else ():
            d = distances(fps[own], v)
            if (m := radius(d, r)) is not None:
                near, far = d < m, d >= max(m - r, 0)
                cost = float(near.sum()) ** 2 + float(far.sum()) ** 2
                if best is None or cost < best[0]:
                    best = cost, own[near], own[far]
        if best is not None:
            todo += best[1:]
            continue
        x = fps[own]
        for at in range(0, len(x), BLOCK):
            i, j = np.nonzero(np.bitwise_count(x[at : at + BLOCK, None] ^ x[None, at:]) <= r)
            up = hook(up, own[i[j > i] + at], own[j[j > i] + at])
    return up


def linked(distinct: DataFrame, r: int = BITS, sample: int = SAMPLE, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` (long) that span what ``r`` bits or fewer link."""
    n = distinct.count()
    share = min(1.0, 1.1 * sample / max(1, n))
    some = distinct if share == 1.0 else distinct.filter(F.pmod(F.xxhash64(F.lit(seed), "fp"), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = np.sort(some.select("fp").limit(sample).toArrow().column("fp").to_numpy()).view(np.uint64)
    leaves = int(min(LEAVES, max(1, -(-n // leaf)), max(1, len(drawn) // 24)))
    nodes = grow(drawn, leaves, r, np.random.default_rng(seed))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fps = b.column(0).to_numpy(zero_copy_only=False)
                i, to, _ = visits(fps.view(np.uint64), nodes, r)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(fps[i])], names=["leaf", "fp"])

    def shard(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(own)
        up = link(own.view(np.uint64), r, np.random.default_rng(seed))
        child = np.flatnonzero(up != np.arange(len(own)))
        return own[child], own[up[child]]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []

        def out():
            a, b = shard(np.concatenate(kept))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            leaf_, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(leaf_)) + 1
            for x, part in zip(leaf_[np.concatenate(([0], cuts))].tolist() if len(leaf_) else [], np.split(fps, cuts), strict=False):
                if x != at and kept:
                    yield out()
                    kept = []
                at = x
                kept.append(part.copy())
        if kept:
            yield out()

    visited = cut(distinct.select("fp").mapInArrow(scatter, "leaf int, fp long"))
    # at most LEAVES rows: how many blocks a leaf needs
    sizes = visited.groupBy("leaf").agg(F.greatest(F.ceil(F.count("*") / leaf), F.lit(1)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col("blocks")).cast("int")
    paired = visited.join(F.broadcast(sizes), "leaf").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shard_of = F.xxhash64("leaf", F.least("mine", "other"), F.greatest("mine", "other"))
    return paired.select(shard_of.alias("leaf"), "fp").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(gather, "a long, b long")


def classes(prints: DataFrame, r: int = BITS, doc_id: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``prints``: the smallest id in its component (null ids count only where there are no others)."""
    distinct = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("first_id")))
    roots = components(linked(distinct, r)).withColumnRenamed("v", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, r: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fingerprint (16 hex digits) and component_id.

    Empty, blank and null texts have fingerprint zero and link like any other;
    fewer words than a shingle are one shingle of all of them. Repeated rows are kept,
    each with its class. A null id stays null and is a class's id only if all its ids
    are null. An empty table gives no rows. Other columns are not read.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text"), shingle))
    named = prints.join(classes(prints, r), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, r: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class one row with its smallest id stays.

    Rows are told apart by two 64-bit hashes of id and text; rows equal in both are
    repeated rows, of which one stays. The classes are found without the texts; one
    join on the hashes, the only shuffle of texts, picks the rows that stay.
    """
    names = docs.columns
    keyed = docs.withColumns({"__h": F.xxhash64("doc_id", "text"), "__g": F.xxhash64(F.lit(1), "text", "doc_id")})
    prints = cut(fingerprints(keyed.select("doc_id", "__h", "__g", "text"), shingle))
    named = prints.join(classes(prints, r).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "__g")).alias("first")
    stay = named.groupBy("root").agg(first).select("first.__h", "first.__g")
    return keyed.join(stay, ["__h", "__g"], "left_semi").dropDuplicates(["__h", "__g"]).select(*names)


def keep_one_similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """As ``keep_one``, where texts whose word shingles are 0.8 similar (Jaccard) are near duplicates, at whatever distance their fingerprints lie.

    Fingerprints of the sets of shingles go through the tree at ``BITS`` bits; what it
    links is one class of candidates, of which an exact check by whole sets follows.
    Pairs of that similarity differ in up to 17 bits. At 6 bits or more no vantage point
    parts fingerprints at a gain (on sf0.1 every node sends all of them to both sides),
    so pairs of different classes come from exact prefixes of the sets (``jaccard``);
    pairs inside a class are not formed there. No similar pair is lost either way.
    """
    return jaccard.keep_one(docs, shingle, majority, linked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
