"""How filters interact: what each removes in every order, by incremental retraction streaming.

Five filters judge a document: A (too few words), B (too few different words), C (too
many capitals), D (holds a symbol) and E (the same text as a document of smaller id).
A to D depend on the document alone; E depends on all documents. The files are read as
a stream in micro-batches until they are at an end. State keyed by text has the
smallest id seen with each text; a document enters the counters of its part with the
filters that it fails as far as is known. Where a smaller id arrives later, the entry of
the former smallest is retracted and counted again with E. Counters are sums of such
changes and do not depend on the order of files.

State is kept in buckets of texts' digests: a Python call for each text takes 1.6 to
3.5 ms of a core, one for a bucket hardly more. Copies within an Arrow batch are summed
before the shuffle, so a hot text is a row a batch. Micro-batches, state and their
results lie in the shared folder; a batch that is run again replaces its own part.

From counters by part and set of failed filters (32 of them) follows the audit of all
120 orders: nothing else of the documents is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquery.llm.common import WORD, let
from docquery.sources.storage import scratch

QUERY = "op11_filter_audit"
FILTERS = "ABCDE"
#: The bit of the filter that looks at other documents.
COPY = 16
#: Micro-batches that the files are dealt into, and texts that a bucket of state is meant for.
BATCHES = 8
BUCKET_TEXTS = 2048
#: The setting that names the state store. Spark's default one holds a text's 50 bytes in an executor's memory; a session
#: that names RocksDB keeps them on disk, at 4 MB of disk for each of its state's partitions however small.
STORE = "spark.sql.streaming.stateStore.providerClass"

ENTRY = "k1 long, k2 long, id long, part string, code int, n long"
_FIELDS = [f.split()[0] for f in ENTRY.split(", ")]
_STATE = ", ".join(f"{n} array<{k}>" for n, k in (f.split() for f in ENTRY.split(", ")))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, k1, k2) of documents (doc_id, text, lang): the bits of the failed filters A to D, and a digest of the text as two numbers. Null text is empty, null lang the empty part."""
    text = F.coalesce("text", F.lit(""))

    def mask(words) -> F.Column:
        n = F.size(words)
        return (
            F.when(n < 100, 1).otherwise(0)
            + F.when(F.size(F.array_distinct(words)) * 100 < n * 80, 2).otherwise(0)
            + F.when(F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10, 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
        )

    digest = F.md5(text)
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), let(F.regexp_extract_all(text, F.lit(WORD), 0), mask).alias("mask"), number(1).alias("k1"), number(16).alias("k2"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``code``: the mask with bit 32 where quality is 1 and 64 where toxic is 1 (a document with several label rows: where any has 1)."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic")).filter("good = 1 or toxic = 1")
    return rows.join(known, "doc_id", "left").withColumn("code", F.col("mask") + F.coalesce("good", F.lit(0)) * 32 + F.coalesce("toxic", F.lit(0)) * 64)


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, k1, k2, id, part, code, lost: no id) to one for each text, part and code: how many they are, how many of them have no id, the smallest id, and how many have it."""
    keys = ["bucket", "k1", "k2", "part", "code"]
    for b in batches:
        if not len(b):
            continue
        # those without an id have the largest number here, so they are the smallest only where all are
        least = b.groupby(keys)["id"].transform("min")
        b = b.assign(n=1, n_least=((b["id"] == least) & ~b["lost"]).astype("int64"), n_lost=b["lost"].astype("int64"))
        yield b.groupby(keys, as_index=False).agg(id=("id", "min"), n=("n", "sum"), n_least=("n_least", "sum"), n_lost=("n_lost", "sum"))[[f.split()[0] for f in COMBINED.split(", ")]]


COMBINED = "bucket int, k1 long, k2 long, id long, part string, code int, n long, n_least long, n_lost long"
CHANGES = "part string, code int, change long"


def retracted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters as rows of a bucket arrive; the state has the documents of the smallest id of each text."""
    came = pd.concat(list(batches))
    old = pd.DataFrame(dict(zip(_FIELDS, state.get, strict=True))) if state.exists else None
    changes = [came.assign(change=came["n_lost"]), came.assign(code=came["code"] | COPY, change=came["n"] - came["n_lost"])]
    new = came[came["n_least"] > 0].assign(n=lambda d: d["n_least"])[_FIELDS]
    both = new.assign(old=False) if old is None else pd.concat([old.assign(old=True), new.assign(old=False)])
    stays = both["id"] == both.groupby(["k1", "k2"])["id"].transform("min")
    passed, gone = both[stays & ~both["old"]], both[~stays & both["old"]]
    # who has the smallest id fails no longer, whom a smaller one displaces fails from now on
    changes += [passed.assign(change=passed["n"]), passed.assign(code=passed["code"] | COPY, change=-passed["n"])]
    changes += [gone.assign(change=-gone["n"]), gone.assign(code=gone["code"] | COPY, change=gone["n"])]
    kept = both[stays].groupby(["k1", "k2", "id", "part", "code"], as_index=False)["n"].sum()
    if len(kept):
        state.update(tuple(kept[f].tolist() for f in _FIELDS))
    out = pd.concat([c[["part", "code", "change"]] for c in changes]).groupby(["part", "code"], as_index=False)["change"].sum()
    yield out.astype({"code": np.int32, "change": np.int64})


def counters(stream: DataFrame, labels: DataFrame, buckets: int, folder: str) -> DataFrame:
    """(part, mask, good, toxic, n) of a stream of documents when it is at an end: how many documents of a part fail just these filters.

    ``labels`` (doc_id, quality, toxic) may cover some documents. ``buckets``: of state,
    fixed for a checkpoint. ``folder``: in the shared storage, for state and results; a
    run that stopped goes on from there. Null text is empty and null lang the empty part;
    documents without an id have no smaller one and are none: they never fail E, and
    nothing fails E by them. Rows of equal id and text are equally small. An empty table
    has no counters.
    """
    rows = labelled(judged(stream), labels)
    rows = rows.select((F.col("k1") % buckets).cast("int").alias("bucket"), "k1", "k2", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "part", "code", F.isnull("doc_id").alias("lost"))
    changes = rows.mapInPandas(combined, COMBINED).groupBy("bucket").applyInPandasWithState(retracted, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)

    spark = stream.sparkSession
    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")  # a table without files has no batch

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "code").agg(F.sum("change").alias("change")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(CHANGES).parquet(f"{folder}/changes")
    code = F.col("code")
    return written.groupBy("part", "code").agg(F.sum("change").alias("n")).select("part", code.bitwiseAND(31).alias("mask"), code.bitwiseAND(32).alias("good"), code.bitwiseAND(64).alias("toxic"), "n")


def audit(counted: DataFrame) -> DataFrame:
    """The audit of all orders from ``counters``: one row for each part, order of the filters and step."""
    steps = [(k, "".join(order), step + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:step])) for k, order in enumerate(permutations(FILTERS)) for step, f in enumerate(order)]
    plan = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("own"), F.lit(b).alias("before")) for _, o, s, f, b in steps])
    # a row for each part with its counts of the 32 sets, so that a part's 600 rows come from one row
    n = [F.sum(F.when(F.col("mask") == m, F.col("n")).otherwise(0)).alias(f"n{m}") for m in range(32)]
    good = [F.sum(F.when((F.col("mask") == m) & (F.col("good") > 0), F.col("n")).otherwise(0)).alias(f"g{m}") for m in range(32)]
    toxic = [F.sum(F.when((F.col("mask") == m) & (F.col("toxic") > 0), F.col("n")).otherwise(0)).alias(f"t{m}") for m in range(32)]
    parts = counted.groupBy("part").agg(*n, *good, *toxic)
    sets = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(factorial(5) // max(m.bit_count(), 1)).alias("firsts"), F.col(f"n{m}").alias("n"), F.col(f"g{m}").alias("g"), F.col(f"t{m}").alias("t")) for m in range(32)])
    rows = parts.select("part", F.explode(sets).alias("s")).select("part", "s.*", F.explode(plan).alias("p"))
    own, before = F.col("m").bitwiseAND(F.col("p.own")) != 0, F.col("m").bitwiseAND(F.col("p.before")) != 0

    def total(when, value="n"):
        return F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")

    return rows.groupBy("part", F.col("p.filter_order").alias("filter_order"), F.col("p.step").alias("step")).agg(
        total(~own & ~before).alias("kept"),
        total(own & ~before).alias("removed"),
        total(own & before).alias("redundant"),
        total(F.col("m") == F.col("p.own")).alias("unique_fails"),
        total(own & ~before, "g").alias("good_lost"),
        total(own & ~before, "t").alias("toxic_lost"),
        # of the orders, a share of one in the number of a document's failed filters has this one first
        F.sum(F.when(own, F.col("n") * F.col("firsts")).otherwise(0)).cast("long").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of ``documents`` in micro-batches, with ``labels``."""
    path = f"{sf_dir}/documents.parquet"
    table = spark.read.parquet(path)
    own = spark.newSession()  # settings of the stream stay its own
    for name in (STORE, "spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    files = max(1, -(-len(table.inputFiles()) // BATCHES))
    # as a pattern, since a stream takes a single file in no other form; it fits a folder as well
    stream = own.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/documents.parque[t]")
    buckets = max(1, -(-table.count() // BUCKET_TEXTS))
    counted = counters(stream, own.read.parquet(f"{sf_dir}/labels.parquet"), buckets, scratch(spark, "filter-audit"))
    return audit(counted)


def _sql() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (
  SELECT d.doc_id, d.part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d JOIN first USING (text)
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic
  FROM m LEFT JOIN labels l ON m.doc_id = l.doc_id GROUP BY part, mask
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, range(1, 6) AS r(step)
), p AS (
  SELECT part, filter_order, step,
    sum(n) FILTER (mask & own = 0 AND mask & before = 0) AS kept,
    sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS redundant,
    sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS toxic_lost,
    own
  FROM c, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM p
"""


#: Independent of the operator: every order is counted from documents and the shares are summed over the orders.
ORACLE_SQL = _sql()
