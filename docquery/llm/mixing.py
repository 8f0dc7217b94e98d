"""Mixing sources to target weights by weighted fair queueing.

Every document, shuffled by a seeded key, gets a virtual finish time: the tokens of
its source up to its end, divided by the source's target weight. The queue is ordered
by that time and cut where the total budget is spent. Weights are here the sources'
targets, in tokens: by virtual time v a source has sent v times its target, so the
budget, which is the sum of the targets, is spent at virtual time 1, and the cut is a
filter that needs no running total over the whole queue. The cut takes a document
when at least half of it lies before time 1, so that each source ends within half a
document of its target. A source whose target exceeds its size sends its documents
again, in the same order, up to three times.

Running totals come in two levels (``common.running_total``): a source with a third of
all rows is sorted in thousands of range buckets, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.common import cut, documents, key_bucket, n_words, running_total, shuffle_key

QUERY = "op1_mixture"
SEED, MOST_REPEATS = "mixture-1", 3


def source_targets(sizes: DataFrame, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources from (source, source_size long): one row a source.

    Sources weigh 1, 2, 3, repeating, by code point, null last. Together they get
    ``share`` of all sizes in proportion to their weights; a target stops at ``most``
    times its source's size and what is over goes to the others by weight, until none
    is above. Filling in the order of cap over weight finds that level at once: a
    source is full if the level that the fuller ones leave reaches its cap.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select("source", "source_size", (1 + (F.row_number().over(by_name) - 1) % 3).cast("long").alias("weight"))
    capped = weighed.withColumn("cap", most * F.col("source_size")).withColumn("budget", (F.lit(share) * F.sum("source_size").over(everything)).cast("long"))
    before = Window.orderBy((F.col("cap") / F.col("weight").cast("double")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = capped.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = (F.col("budget") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left")
    marked = filled.withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((rest * F.col("weight")).cast("double") / weights.cast("double"))
    return marked.withColumn("target", target).select("source", "source_size", "weight", "target")


def queue(docs: DataFrame, seed: str = SEED, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with size, source_size, target, first_finish and copies.

    first_finish is the virtual finish time of the first copy of a document; the next
    copies finish source_size / target later each. copies is how many the mix takes.
    Sizes are words; null or blank texts have none: they finish with the one before
    and are never taken. Ties in the key are ordered by id, then by the text's
    checksum; rows equal in these are repeated rows and interchangeable. Columns of
    the names that are added are replaced. An empty table gives no rows.
    """
    made = ["size", "source_size", "weight", "target", "first_finish", "copies"]
    docs = docs.drop(*made)
    rows = docs.withColumn("size", n_words(F.col("text"))).withColumn("__key", shuffle_key(seed, F.col("doc_id"))).withColumn("__bucket", key_bucket(F.col("__key"))).withColumn("__crc", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    return _queued(rows, share, most).drop("__key", "__bucket", "__crc", "__ahead")


def _queued(rows: DataFrame, share: float, most: int) -> DataFrame:
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)).withColumnRenamed("source", "__source")
    rows = running_total(rows, ["source"], "__bucket", ["__key", "doc_id", "__crc", "size"], F.col("size"), "__ahead")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    finish = (F.col("__ahead") + F.col("size")) / F.col("target")
    # copy e is taken if e * source_size + ahead + size / 2 <= target
    room = (F.col("target") - F.col("__ahead") - F.col("size") / 2.0) / F.col("source_size")
    copies = F.when((F.col("size") == 0) | (room < 0), 0).otherwise(F.least(F.lit(most), F.floor(room) + 1))
    return rows.withColumn("first_finish", F.when(F.col("target") > 0, finish)).withColumn("copies", F.coalesce(copies, F.lit(0)).cast("int"))


def mix(docs: DataFrame, seed: str = SEED, share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """The mixture itself: the rows of ``docs`` that it takes, each as often as it takes it, in the order of the queue (range-sorted by virtual finish time). Columns pass through, whatever their names.

    The queue is made of ids and numbers; whole rows are joined to what it takes once
    and sorted once. Rows are told apart by two 64-bit hashes of all their columns;
    rows equal in both are repeated rows, of which one stands for all.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashes = [F.xxhash64(row).alias("__h"), F.xxhash64(F.lit(1), row).alias("__g")]
    taken = _planned(docs, seed, share, most, *hashes).filter("copies > 0")
    again = taken.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = F.col("first_finish") + F.col("__copy") * F.col("source_size") / F.col("target")
    places = again.select("__h", "__g", finish.alias("__finish"), F.col("source").alias("__source"), F.col("doc_id").alias("__id"))
    rows = docs.select(row.alias("__row"), *hashes).dropDuplicates(["__h", "__g"])
    return rows.join(places.hint("merge"), ["__h", "__g"]).orderBy("__finish", "__source", "__id").select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """What the mix takes of every row (doc_id, source, text): ids and numbers alone are shuffled, no texts."""
    return _planned(docs, seed, 1.0, MOST_REPEATS)


def _planned(docs: DataFrame, seed: str, share: float, most: int, *more: Column) -> DataFrame:
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key(seed, F.col("doc_id")).alias("__key"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("__crc"), *more)
    rows = cut(rows.withColumn("__bucket", key_bucket(F.col("__key"))))
    return _queued(rows, share, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "first_finish")


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mixture-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) AS weight,
         3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget
  FROM sizes
), filled AS (
  SELECT *, CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS cap_before,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left
  FROM weighed
  WINDOW before AS (ORDER BY cap / CAST(weight AS DOUBLE) ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, (budget - cap_before) * weight >= cap * weight_left AS is_full FROM filled
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST((budget - CAST(coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS BIGINT)) * weight AS DOUBLE)
                   / CAST(sum(weight) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target
  FROM marked
), queued AS (
  SELECT r.*, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CASE WHEN size = 0 OR (target - ahead - size / 2.0::DOUBLE) / source_size < 0 THEN 0
                 ELSE least(3, CAST(floor((target - ahead - size / 2.0::DOUBLE) / source_size) AS INTEGER) + 1) END AS copies
  FROM queued
)
SELECT doc_id, source, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN target > 0 THEN (ahead + size) / target END AS first_finish
FROM counted
"""
