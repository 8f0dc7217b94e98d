"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, the projections are shifted
and quantised, and several of them together name a bucket; vectors at a small distance
share a bucket in at least one of several tables with high probability. Candidates of
a bucket get an exact cosine in double precision, so no pair below the threshold is
linked.

Equal vectors are made one first, with a weight, so a vector with millions of copies is
one row. Buckets larger than ``BLOCK`` are split into blocks, and every pair of blocks
is a task of its own: no bucket has to fit in one task, and none is capped. A pair that
meets in several tables counts in the first of them, which its own hashes tell. Tasks
report sums of weights and a spanning forest of links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import cut
from docquery.llm.components import components
from docquery.llm.simhash import hook

QUERY = "op4_embedding_links"
ORACLE_SQL = None
LEAST_COSINE = 0.95
#: Quantum of projections, seed of the directions, rows of a block.
QUANTUM, SEED, BLOCK = 1.25, 11, 2000
#: Unrelated vectors that a bucket may hold on average; share of pairs at the threshold that may meet in no table.
CROWD, MISSED = 8, 0.015


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, every component a finite number, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def collision(distance: float, quantum: float = QUANTUM) -> float:
    """Chance that two vectors at a distance fall into the same cell of one projection."""
    x = quantum / distance
    return 1 - math.erfc(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def tuned(n: int, least: float = LEAST_COSINE) -> tuple[int, int]:
    """(tables, projections) for ``n`` vectors: as many projections as keep unrelated vectors of a bucket to ``CROWD``, and as many tables as then find all but ``MISSED`` of the pairs at the threshold. So work grows little faster than ``n``, and recall stays."""
    projections = max(3, math.ceil(math.log(max(n, 1) / CROWD) / -math.log(collision(math.sqrt(2)))))
    return math.ceil(math.log(MISSED) / math.log(1 - collision(math.sqrt(2 - 2 * least)) ** projections)), projections


def directions(dim: int, tables: int, projections: int, quantum: float = QUANTUM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, quantum, tables * projections)


def hashes(unit: np.ndarray, tables: int, projections: int, quantum: float = QUANTUM, seed: int = SEED) -> np.ndarray:
    """A 64-bit bucket for each vector and table, from its quantised projections."""
    at, shift = directions(unit.shape[1], tables, projections, quantum, seed)
    cells = np.floor((unit @ at + shift) / quantum).astype(np.int64).reshape(len(unit), tables, projections)
    odd = np.random.default_rng([seed, 1]).integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        mixed = (cells * odd).sum(axis=2)
        return mixed ^ (mixed >> 29)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that very large and very small components don't overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a list column's values, and all of them in a row, in double precision."""
    return np.diff(column.offsets.to_numpy()), np.asarray(column.flatten(), dtype=np.float64)


def same_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length of vectors in a column."""
    lengths, flat = matrix(column)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield at, normalised(flat[starts[at][:, None] + np.arange(dim)])


def _buckets(tables: int, projections: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                for at, unit in same_length(b.column(2)):
                    h = hashes(unit, tables, projections)
                    rows = np.repeat(at, tables)
                    part = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(h.ravel()), pa.array(np.full(len(rows), unit.shape[1], np.int32)), *part.columns], names=["t", "bucket", "dim", "id", "weight", "vector"])

    return run


def _pairs(t: int, cross: bool, left: np.ndarray, unit: np.ndarray, weight: np.ndarray, least: float, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one task: the weight that each links first in table ``t``, and the root position of each."""
    n = len(unit)
    own, sums, up = hashes(unit, tables, projections)[:, : t + 1], np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, 512):
        rows = np.arange(at, min(n, at + 512))
        i, j = np.nonzero(unit[rows] @ unit.T >= least)
        i = i + at
        ok = j > i
        if cross:
            ok &= left[i] != left[j]
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            first = own[a, t] == own[b, t]
            for earlier in range(t):
                first[first] = own[a[first], earlier] != own[b[first], earlier]
            a, b = a[first], b[first]
            sums += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
            up = hook(up, a, b)
    return sums, up


def _link(least: float, tables: int, projections: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[tuple, pa.Table]]:
            at, kept = None, []
            for b in batches:
                keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
                cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1 if len(keys) else []
                for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                    if start == end:
                        continue
                    key = tuple(keys[start].tolist())
                    if key != at and kept:
                        yield at, pa.Table.from_batches(kept)
                        kept = []
                    at = key
                    kept.append(b.slice(start, end - start))
            if kept:
                yield at, pa.Table.from_batches(kept)

        ids, sums_, roots = [], [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(roots)), pa.array(np.concatenate(sums_))], names=["id", "root", "links"])
            ids.clear(), roots.clear(), sums_.clear()
            return made

        for (t, _, _, p, q), rows in groups():
            own, weight = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
            if len(own) < 2:
                continue
            unit = next(same_length(rows.column("vector").combine_chunks()))[1]
            found, up = _pairs(t, p != q, rows.column("block").to_numpy(), unit, weight, least, tables, projections)
            if (some := np.flatnonzero(found)).size:
                ids.append(own[some]), roots.append(own[up[some]]), sums_.append(found[some])
            if len(ids) > 500:
                yield out()
        if ids:
            yield out()

    return run


def links(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """Distinct vectors (id long, weight long, vector array) to (id, root, links): per task the weight of what each links, and a vector that it is linked with."""
    tables, projections = tuned(vectors.count(), least)
    placed = vectors.select("id", "weight", "vector").mapInArrow(_buckets(tables, projections), "t int, bucket long, dim int, id long, weight long, vector " + vectors.schema["vector"].dataType.simpleString())
    keys = ["t", "bucket", "dim"]
    # buckets of one vector have no pairs; the others are split into as many blocks as their size asks for
    shared = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    there = placed.join(shared.hint("shuffle_hash"), keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = there.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    task = [*keys, "p", "q"]
    dealt = meets.select(*task, "block", "id", "weight", "vector").repartition(*task).sortWithinPartitions(*task)
    return dealt.mapInArrow(_link(least, tables, projections), "id long, root long, links long")


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``embeddings`` (vec_id, embedding) to vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and so do vectors of different lengths. Equal vectors have cosine 1 and
    link. Repeated rows are vectors of their own: a repeated id is kept as often as it
    comes, and its copies link. A null id stays null; it is a component's id only if
    all ids there are null. An empty table gives no rows; other columns are not read.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector")).withColumn("usable", usable(F.col("vector")))
    good = rows.filter("usable")
    same = good.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight")).withColumn("id", F.xxhash64("vector", F.size("vector")))
    same = cut(same)
    found = cut(links(same, least))
    roots = components(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "id")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = same.join(sums, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "root").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id")
    linked = good.withColumn("id", F.xxhash64("vector", F.size("vector"))).select("vec_id", "id").join(known, "id").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
