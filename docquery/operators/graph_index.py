"""An index for approximate search: proximity graphs over parts of the rows.

Rows are dealt into parts of bounded size by a hash of their id. Within a part each
distinct vector is a node that points to near ones in different directions; a search
walks from a few entries along the links to ever nearer nodes and meets a small share of
the part, which grows far slower than the part. Every part is searched and the best of
all are merged, so parts are independent: building is one task a part, searching is one
task for a part and a block of queries, and neither passes the driver.

The index is a Parquet table of generations. Appending writes a generation of its own
for the new rows alone; no older part is touched. ``compacted`` makes one of many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.operators.search import _best, top_k
from docquery.sources.storage import cut

#: Rows of a part, links of a node, nearest nodes that its links are chosen from, and entries of a part.
PART_ROWS, LINKS, POOL, ENTRIES = 16_384, 12, 64, 8
#: A part of no more than so many nodes for each of the beam is compared whole, which takes less time than the walk (measured: at 11,400 nodes of 64 dimensions the walk costs as much from a beam of 14 on, and eight times as much at 112).
WHOLE = 128
#: Bytes of query vectors that a task has at once.
QUERY_BYTES = 64 << 20
SCHEMA = "part int, dim int, node int, ids array<long>, vector array<double>, links array<int>, entry boolean"


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def graph(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node (-1: none) and the entries, from distinct unit vectors.

    Of the nearest nodes those are linked that are nearer to the node than to any link
    before them, then the nearest of the others. Nodes that no walk from the entries
    reaches are linked from the nearest one that is reached.
    """
    n, dim = unit.shape
    pool = min(POOL, n - 1)
    links = np.full((n, 2 * LINKS), -1, np.int32)
    step = max(1, min(1024, (1 << 24) // max(1, pool * dim)))
    for at in range(0, n if pool else 0, step):
        own = np.arange(at, min(n, at + step))
        near = unit[own] @ unit.T
        near[np.arange(len(own)), own] = -np.inf
        found = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        score = np.take_along_axis(near, found, axis=1)
        order = np.lexsort((found, -score), axis=1)
        found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
        v = unit[found]
        among = v @ v.transpose(0, 2, 1)
        kept = np.zeros(found.shape, bool)
        for r in range(pool):
            kept[:, r] = ~(kept & (among[:, r, :] > score[:, r : r + 1])).any(axis=1) & (kept.sum(axis=1) < LINKS)
        first = np.argsort(~kept, axis=1, kind="stable")[:, :LINKS]
        links[own, : first.shape[1]] = np.take_along_axis(found, first, axis=1)
    # entries far from each other
    entries, far = [0], unit @ unit[0]
    while len(entries) < min(ENTRIES, n):
        entries.append(int(np.argmin(far)))
        far = np.maximum(far, unit @ unit[entries[-1]])
    reached, extra = np.zeros(n, bool), np.zeros(n, np.int32)
    _reach(links, np.array(entries), reached)
    while not reached.all():
        lost = int(np.argmin(reached))
        open_to = np.flatnonzero(reached & (extra < LINKS))
        by = open_to[np.argmax(unit[open_to] @ unit[lost])]
        links[by, LINKS + extra[by]] = lost
        extra[by] += 1
        _reach(links, np.array([lost]), reached)
    return links, np.unique(entries)


def _reach(links: np.ndarray, start: np.ndarray, reached: np.ndarray) -> None:
    reached[start] = True
    while len(start):
        to = np.unique(links[start])
        start = to[(to >= 0) & ~reached[to]]
        reached[start] = True


def walk(unit: np.ndarray, links: np.ndarray, entries: np.ndarray, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``beam`` best nodes that a walk meets (scores; nodes, -1: none), and how many it met. All queries walk a step at a time."""
    m, n = len(asked), len(unit)
    seen = np.zeros((m, n), bool)
    seen[:, entries] = True
    nodes = np.broadcast_to(entries, (m, len(entries)))
    scores = asked @ unit[entries].T
    nodes, scores, done = np.pad(nodes, ((0, 0), (0, beam)), constant_values=-1), np.pad(scores, ((0, 0), (0, beam)), constant_values=-np.inf), np.zeros((m, len(entries) + beam), bool)

    def best(nodes, scores, done):
        order = np.lexsort((nodes, -scores), axis=1)[:, :beam]
        return (np.take_along_axis(x, order, axis=1) for x in (nodes, scores, done))

    nodes, scores, done = best(nodes, scores, done)
    active = np.arange(m)
    while True:
        waits = ~done[active] & (nodes[active] >= 0)
        some = waits.any(axis=1)
        active, waits = active[some], waits[some]
        if not len(active):
            return scores, nodes, seen.sum(axis=1)
        at = waits.argmax(axis=1)
        done[active, at] = True
        to = links[nodes[active, at]]
        new = (to >= 0) & ~seen[active[:, None], to]
        seen[np.repeat(active, new.sum(axis=1)), to[new]] = True
        score = np.full(to.shape, -np.inf)
        row, col = np.nonzero(new)
        score[row, col] = np.einsum("ij,ij->i", asked[active[row]], unit[to[row, col]])
        got = best(np.concatenate((nodes[active], np.where(new, to, -1)), axis=1), np.concatenate((scores[active], score), axis=1), np.concatenate((done[active], np.zeros(to.shape, bool)), axis=1))
        nodes[active], scores[active], done[active] = got


def built(chunks: DataFrame, *, chunk_id: str = "vec_id", vector: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """Rows of an index of all rows of ``chunks``. Vectors that are null or empty or hold null or non-finite components are not in it; equal vectors of a part are one node."""
    rows = chunks.select(F.col(chunk_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter((F.size("vector") > 0) & ~F.exists("vector", bad))
    parts = max(1, -(-chunks.count() // part_rows))
    dealt = rows.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "dim": F.size("vector")})

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids, vectors = table.column("id").to_numpy(), _vectors(table.column("vector"))
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        _, first, node = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        links, entries = graph(_unit(vectors[first]))
        held = np.argsort(node, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(node))).astype(np.int32)
        kept = links >= 0
        to = np.append(0, np.cumsum(kept.sum(axis=1))).astype(np.int32)
        n, dim = len(first), vectors.shape[1]
        return pa.table(
            {
                "part": pa.array(np.full(n, key[0].as_py(), np.int32)),
                "dim": pa.array(np.full(n, dim, np.int32)),
                "node": pa.array(np.arange(n, dtype=np.int32)),
                "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[held])),
                "vector": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vectors[first].ravel())),
                "links": pa.ListArray.from_arrays(pa.array(to), pa.array(links[kept])),
                "entry": pa.array(np.isin(np.arange(n), entries)),
            }
        )

    return dealt.groupBy("part", "dim").applyInArrow(build, SCHEMA)


def write(chunks: DataFrame, path: str, **options) -> None:
    """A new index at ``path``; see ``built``."""
    built(chunks, **options).write.parquet(f"{path}/generation=0")


def append(chunks: DataFrame, path: str, **options) -> None:
    """New rows into the index at ``path``, as a generation of their own; what is there stays as it is."""
    last = read(chunks.sparkSession, path).agg(F.max("generation")).head()[0]
    built(chunks, **options).write.parquet(f"{path}/generation={0 if last is None else last + 1}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, generation int").parquet(path)


def compacted(index: DataFrame, path: str, **options) -> None:
    """One generation of all, written to the new ``path``: parts are full again."""
    write(index.select(F.explode("ids").alias("id"), "vector"), path, chunk_id="id", vector="vector", **options)


def beam_for(index: DataFrame, queries: DataFrame, k: int, *, recall: float = 0.95, sample: int = 128, skip_same_id: bool = True) -> int:
    """The first of the beams ``k`` + 4, twice that and so on with which the search finds ``recall`` of the exact ``k`` nearest rows, measured on ``sample`` of the queries (those of the smallest hashes), or one as wide as the largest part.

    Queries that are rows of a part need a narrow beam there; in other parts, and in
    generations appended later, they are strangers and need a wide one.
    """
    some = cut(queries.select("query_id", "query_vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    want = cut(top_k(index.select(F.explode("ids").alias("vec_id"), "vector"), some, k, vector="vector", skip_same_id=skip_same_id).select("query_id", "vec_id"))
    n = want.count()
    largest = index.groupBy("generation", "part", "dim").count().agg(F.max("count")).head()[0] or 0
    beam = k + 4
    while beam < largest:
        # some beams in one reading of the index
        tried = [b for b in (beam, 2 * beam, 4 * beam, 8 * beam) if b < largest] if beam == k + 4 else [beam]  # wide ones are dear
        by = Window.partitionBy("beam", "query_id").orderBy(F.desc_nulls_last("score"), "id")
        best = _met(index, some, k, tried, None, skip_same_id).filter(F.col("id").isNotNull()).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        hits = dict(tuple(r) for r in want.join(best.withColumnRenamed("id", "vec_id"), ["query_id", "vec_id"]).groupBy("beam").agg(F.count("*")).collect())
        for b in tried:
            if hits.get(b, 0) >= recall * n:
                return b
        beam = 2 * tried[-1]
    return beam


def search(index: DataFrame, queries: DataFrame, k: int, *, beam: int | None = None, chunk_id: str = "vec_id", threshold: float | None = None, skip_same_id: bool = True) -> DataFrame:
    """For each query (query_id, query_vector) the ``k`` best rows that walks through all parts meet: (query_id, ``chunk_id``, score, rank, visited).

    ``score`` is the cosine in double precision, rounded to six digits; ties go by id.
    ``beam``: how many of the best nodes a walk goes on from, k + 4 by default; a
    wider one meets more rows and misses fewer. ``visited``: rows whose vector was
    compared with the query, in all parts: where the beam is wide for a part (``WHOLE``) all of it. Queries whose vector is null or of another
    length than the rows' find nothing.
    """
    found = _met(index, queries, k, [max(beam or k + 4, k + 1)], threshold, skip_same_id)
    whole = Window.partitionBy("query_id")
    ranked = found.withColumns({"visited": F.sum("visited").over(whole), "rank": F.row_number().over(whole.orderBy(F.desc_nulls_last("score"), "id"))})
    return ranked.filter((F.col("rank") <= k) & F.col("id").isNotNull()).select("query_id", F.col("id").alias(chunk_id), "score", "rank", "visited")


def _best_ids(qids: np.ndarray, scores: np.ndarray, nodes: np.ndarray, ends: np.ndarray, ids: np.ndarray, k: int, threshold: float | None, skip_same_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of the ``k`` best rows of each query: of a node (its ids: ``ids`` between two ``ends``) no more than k + 1 rows can be among them."""
    query, at = np.nonzero(nodes >= 0)
    node, score = nodes[query, at], np.round(scores[query, at], 6)
    times = np.minimum(ends[node + 1] - ends[node], k + 1)
    own = ids[np.repeat(ends[node] - np.cumsum(times) + times, times) + np.arange(times.sum())]
    query, score = np.repeat(query, times), np.repeat(score, times)
    if skip_same_id:
        other = own != qids[query]
        query, own, score = query[other], own[other], score[other]
    order = np.lexsort((own, -score, query))
    query, own, score = query[order], own[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    if threshold is not None:
        kept &= score >= threshold - 1e-12
    return query[kept], own[kept], score[kept]


def _met(index: DataFrame, queries: DataFrame, k: int, beams: list[int], threshold: float | None, skip_same_id: bool) -> DataFrame:
    """(query_id, id, score, visited, beam): what walks of each of the beams through each part find best, and a row without an id for what they met."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("asked"), F.size("query_vector").alias("dim"))
    size = asked.agg(F.sum(F.greatest(F.col("dim"), F.lit(0)).cast("long") * 8)).head()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    key = ["generation", "part", "dim", "block"]
    parts = index.select(F.col("generation").alias("g"), F.col("part").alias("p"), F.col("dim").alias("d")).distinct()
    met = asked.select("query_id", "asked", "dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b")).join(parts, F.col("dim") == F.col("d")).drop("dim")
    dealt = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("visited", pa.int64()), ("beam", pa.int32())])

    def step(own: pa.Table, queries: pa.Table) -> pa.Table:
        if not (own.num_rows and queries.num_rows):
            return schema.empty_table()
        out = []
        own = own.sort_by("node")
        unit, lists = _unit(_vectors(own.column("vector"))), own.column("links").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        width = np.diff(ends)
        links = np.full((len(unit), max(1, width.max())), -1, np.int32)
        links[np.repeat(np.arange(len(unit)), width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)] = flat[ends[0] : ends[-1]]
        entries = np.flatnonzero(own.column("entry").to_numpy(zero_copy_only=False))
        held = own.column("ids").combine_chunks()
        of_node, ids = held.offsets.to_numpy().astype(np.int64), held.values.to_numpy()
        qids, vectors = queries.column("query_id").to_numpy(), _unit(_vectors(queries.column("asked")))
        by_id = np.argsort(ids[of_node[:-1]], kind="stable")  # a node's ids ascend
        placed = unit[by_id]

        def walked(asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return walk(unit, links, entries, asked, beam)

        def compared(asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            scores = np.round(asked @ placed.T, 6)
            scores, at = _best(scores, np.broadcast_to(np.arange(len(placed)), scores.shape), k + 1)
            return scores, by_id[at], np.full(len(asked), len(placed))

        for at, beam in ((at, beam) for at in range(0, len(qids), 256) for beam in beams):
            some = qids[at : at + 256]
            scores, nodes, visited = (walked if len(unit) > WHOLE * beam else compared)(vectors[at : at + 256], beam)
            query, found, score = _best_ids(some, scores, nodes, of_node, ids, k, threshold, skip_same_id)
            out.append(pa.table([some[query], found, score, np.zeros(len(query), np.int64), np.full(len(query), beam, np.int32)], schema=schema))
            none = [pa.nulls(len(some), kind) for kind in (pa.int64(), pa.float64())]
            out.append(pa.table([pa.array(some, pa.int64()), *none, pa.array(visited, pa.int64()), pa.array(np.full(len(some), beam, np.int32))], schema=schema))
        return pa.concat_tables(out).combine_chunks()

    return dealt.groupBy(*key).cogroup(met.groupBy("g", "p", "d", "b")).applyInArrow(step, "query_id long, id long, score double, visited long, beam int")
