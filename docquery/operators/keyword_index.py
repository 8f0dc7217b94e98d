"""A stored index for keyword search by BM25: documents are read when they come, not when they are searched.

Postings (term, level, doc, tf, length) are rows in the order of their term, dealt out
by ranges that may end inside a term, so a term in half of all documents is many
partitions. A level gathers postings of like frequency and document length; of each
level of a term the index knows how many there are, the highest frequency and the
shortest document, which bound what one of them can add to a score. A search reads the
levels that can fill its first k places, takes the score of the k-th as a threshold,
and then reads only levels that can still lead to a document above it. What it returns
is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.operators.search import best_by_keywords, tokens
from docquery.sources.storage import cut, stored

#: Folders that terms are dealt into by hash: a search prunes those without any of its terms.
BUCKETS = 32
#: Frequencies up to which levels tell each apart; above it they double in two steps, as lengths do in four.
EXACT = 8
#: Postings that a search gathers by documents, in one task and in one row, give or take what a hash deals unevenly.
GROUP, PACKED = 1 << 20, 1 << 18
_POSTINGS = "term string, level int, doc long, tf long, length int, generation int, bucket int"
_LEVELS = "bucket int, term string, level int, postings long, max_tf long, min_length int, generation int"
_TOTALS = "docs long, words long, generation int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(documents: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Documents into the index at ``path``, as a generation of their own; the first makes the index. Null text is empty; an id that comes again is another document. ``partitions``: ranges of postings, by default as many as the session's shuffles have."""
    spark = documents.sparkSession
    number = _next(spark, path)
    words = documents.select(F.col(doc_id).cast("long").alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    often = F.when(F.col("tf") <= EXACT, F.col("tf")).otherwise(EXACT + F.floor(2 * F.log2(F.col("tf") / float(EXACT))))
    level = (often * 128 + F.floor(4 * F.log2(F.col("length") + 1.0))).cast("int")
    held = words.mapInArrow(_counted, "term string, doc long, tf long, length int")
    order = [_bucket(F.col("term")), F.col("term"), level, F.col("doc")]
    dealt = held.repartitionByRange(*order) if partitions is None else held.repartitionByRange(partitions, *order)
    postings = dealt.select(order[0].alias("bucket"), "term", level.alias("level"), "doc", "tf", "length")
    postings.sortWithinPartitions("bucket", "term", "level", "doc").write.partitionBy("bucket").parquet(f"{path}/postings/generation={number}")
    own = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/generation={number}")
    own.groupBy("bucket", "term", "level").agg(F.count("*").alias("postings"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length")).write.parquet(f"{path}/levels/generation={number}")
    # last: a generation counts when its totals are there
    own.agg(F.lit(documents.count()).cast("long").alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).write.parquet(f"{path}/totals/generation={number}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words) to postings, those of a thousand documents in the order of their terms: neighbours are alike, so what is shuffled packs well."""
    for whole in batches:
        for part in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
            length = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
            found = part.column(1).flatten().dictionary_encode()
            order = pc.sort_indices(found.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, tf = np.unique(place[found.indices.to_numpy()] * part.num_rows + np.repeat(np.arange(part.num_rows), length), return_counts=True)
            row = keys % part.num_rows
            yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(order[keys // part.num_rows])), part.column(0).take(pa.array(row)), pa.array(tf), pa.array(length[row].astype(np.int32))], names=["term", "doc", "tf", "length"])


def _next(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return 0
    return (spark.read.schema(_TOTALS).parquet(f"{path}/totals").agg(F.max("generation")).head()[0] or 0) + 1


def _saturated(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def plan(spark: SparkSession, path: str, queries: DataFrame, k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, bucket, term, level, postings, idf, mean, bound: what a posting can add, reach: the most a document with one can score, first: whether the level is among those read first) of each level of the terms of queries (query_id, question)."""
    totals = spark.read.schema(_TOTALS).parquet(f"{path}/totals")
    known = totals.select("generation")
    stats = totals.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("mean"))
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    levels = spark.read.schema(_LEVELS).parquet(f"{path}/levels").join(F.broadcast(known), "generation")
    levels = levels.join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term", "level").agg(F.sum("postings").alias("postings"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    of_term, of_query = Window.partitionBy("term"), Window.partitionBy("query_id")
    n = F.sum("postings").over(of_term)
    # one row of totals
    levels = levels.withColumn("df", n).join(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    levels = levels.withColumn("bound", F.col("idf") * _saturated(F.col("max_tf"), F.col("min_length"), F.col("mean"), k1, b)).withColumn("most", F.max("bound").over(of_term))
    met = wanted.join(levels, ["bucket", "term"]).withColumn("one", F.when(F.row_number().over(Window.partitionBy("query_id", "term").orderBy("level")) == 1, F.col("most")).otherwise(0.0))
    met = met.withColumn("reach", F.col("bound") + F.sum("one").over(of_query) - F.col("most"))
    before = F.coalesce(F.sum("postings").over(of_query.orderBy(F.desc("bound"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("first", before < k).select("query_id", "bucket", "term", "level", "postings", "idf", "mean", "bound", "reach", "first")


def _weights(spark: SparkSession, path: str, some: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, doc, weight) of the postings of some levels."""
    known = spark.read.schema(_TOTALS).parquet(f"{path}/totals").select("generation")
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").join(F.broadcast(known), "generation")
    weight = F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean"), k1, b)
    return postings.join(some, ["bucket", "term", "level"]).select("query_id", "doc", weight.alias("weight"))


def needed(spark: SparkSession, path: str, queries: DataFrame, k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The levels of ``plan`` that can hold a posting of a document among a query's best ``k``.

    ``leads`` is false for terms that can't lift a document there even all together:
    their postings count only for documents that have one of the others.
    """
    levels = stored(plan(spark, path, queries, k, k1=k1, b=b), "levels")
    some = _weights(spark, path, levels.filter("first"), k1, b).groupBy("query_id", "doc").agg(F.sum("weight").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    # a millionth below, since scores are rounded to six digits before they are ranked
    least = some.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k).select("query_id", (F.col("score") - 1e-6).alias("least"))
    met = levels.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    terms = met.groupBy("query_id", "term", "least").agg(F.max("bound").alias("most"))
    weak_first = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.select("query_id", "term", (F.sum("most").over(weak_first) >= F.col("least")).alias("leads"))
    return met.filter("reach >= least").join(terms, ["query_id", "term"]).drop("least")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, doc_id: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Queries (query_id, question) to (query_id, ``doc_id``, score, rank), as ``search.bm25`` gives them for the documents of the index; no document is read.

    Postings are dealt by groups of documents, many in one row, and meet the queries
    inside the tasks, which keep the best ``k`` of each (``best_by_keywords``).
    """
    # a term's number, and its levels that any query needs: more of a document than one query needs does its score no harm
    levels = needed(spark, path, queries, k, k1=k1, b=b).groupBy("bucket", "term").agg(F.collect_set("level").alias("levels"), F.first("idf").alias("idf"), F.first("mean").alias("mean"))
    levels = stored(levels, "terms")
    names = levels.select("term", "idf", "mean").toArrow()
    idf = {t: (n, w) for n, (t, w) in enumerate(zip(names.column("term").to_pylist(), names.column("idf").to_pylist(), strict=True))}
    mean = names.column("mean")[0].as_py() if idf else 1.0
    wanted = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")))
    known = spark.read.schema(_TOTALS).parquet(f"{path}/totals")
    total = spark.read.schema(_LEVELS).parquet(f"{path}/levels").join(F.broadcast(known.select("generation")), "generation").join(levels.select("bucket", "term"), ["bucket", "term"], "left_semi").agg(F.sum("postings")).head()[0] or 0
    groups = max(1, -(-total // GROUP))
    postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").join(F.broadcast(known.select("generation")), "generation").join(levels.select("bucket", "term", "levels"), ["bucket", "term"]).filter(F.array_contains("levels", F.col("level")))
    shared = spark.sparkContext.broadcast({t: n for t, (n, _) in idf.items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            group, doc, term, tf, length = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((doc, term, group))
            group, doc, term, tf, length = (c[order] for c in (group, doc, term, tf, length))
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = pa.array(np.append(starts, len(group)).astype(np.int32))
            kinds = (np.int64, np.int32, np.int32, np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(kind))) for c, kind in zip((doc, term, tf, length), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(group[starts].astype(np.int32)), *lists], names=["group", "docs", "terms", "tf", "lengths"])

        for b in batches:
            found = b.column(1).dictionary_encode()
            numbers = np.fromiter((shared.value[t] for t in found.dictionary.to_pylist()), np.int64, len(found.dictionary))
            held.append((b.column(0).to_numpy(), b.column(2).to_numpy(), numbers[found.indices.to_numpy()], b.column(3).to_numpy(), b.column(4).to_numpy()))
            rows += b.num_rows
            if rows >= PACKED:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        at, held = None, []
        for b in batches:
            for x in range(b.num_rows):
                group = b.column(0)[x].as_py()
                if group != at and held:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    held = []
                at = group
                held.append([c[x].values.to_numpy().copy() for c in b.columns[1:]])
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

    # a null id is one of its own, before all others
    none = -(1 << 63)
    doc = F.coalesce("doc", F.lit(none))
    rows = postings.select(F.pmod(F.xxhash64(doc), F.lit(groups)).cast("int").alias("group"), "term", doc.alias("doc"), F.col("tf").cast("int").alias("tf"), "length")
    packed = rows.mapInArrow(pack, "group int, docs array<long>, terms array<int>, tf array<int>, lengths array<int>").repartition("group").sortWithinPartitions("group")
    best = best_by_keywords(packed, blocks, wanted, idf, mean, k, k1, b)
    return best.select("query_id", F.nullif("doc", F.lit(none)).alias(doc_id), "score", "rank")
