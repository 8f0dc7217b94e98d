"""Response-cache behaviour over logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.config import DEFAULTS


def cache_key(question: Column, filters_json: str = "{}") -> Column:
    """The key of a question: md5 of its JSON record with sorted filters (given as JSON text), without case and outer blanks. ASCII questions have the bytes of a JSON dump; others fall into the same classes."""
    plain = F.regexp_replace(F.lower(question), r"^\s+|\s+$", "")
    quoted = F.regexp_replace(F.regexp_replace(plain, r"\\", r"\\\\\\\\"), '"', r'\\\\"')
    quoted = F.replace(F.replace(F.replace(quoted, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit("rag:query:"), F.md5(F.concat(F.lit(f'{{"filters": {filters_json}, "question": "'), quoted, F.lit('"}'))))


def last_before(asked: DataFrame, written: DataFrame, by: list[str], at: str, value: str, name: str, bucket_s: int = 3600) -> DataFrame:
    """Adds ``name``: the ``value`` of the last row of ``written`` (``by``, ``at``, ``value``) at or before each row of ``asked``, of the same ``by``; of rows at one time the largest value.

    Both sides are one stream by key and time, so that no pair of rows is formed. The
    stream of a key is cut into spans of ``bucket_s`` seconds, each a sort of its own;
    what a span begins with comes from one row a span. Rows of a null key or time
    meet nothing.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_s * 1_000_000)).alias("__span")
    new = written.select(*by, F.col(at).alias("__at"), F.col(value).alias("__value"), span(at)).dropna(subset=[*by, "__at"])
    there = F.struct(F.col("__at").alias("at"), F.col("__value").alias("value"))
    spans = new.groupBy(*by, "__span").agg(F.max(there).alias("__last")).unionByName(asked.select(*by, span(at)).distinct().withColumn("__last", F.lit(None).cast(new.select(there.alias("x")).schema["x"].dataType)))
    spans = spans.groupBy(*by, "__span").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*by, "__span", F.max("__last").over(earlier).alias("__carried"))
    rows = asked.select(F.struct(*asked.columns).alias("__row"), *by, F.col(at).alias("__at"), span(at), F.lit(None).cast(new.schema["__value"].dataType).alias("__value"), F.lit(1).alias("__kind"))
    stream = rows.unionByName(new.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*by, "__span").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("__kind") == 0, F.struct(F.col("__at").alias("at"), F.col("__value").alias("value")))).over(so_far)
    found = stream.withColumn("__inside", inside).filter("__kind = 1")
    return found.join(carried, [*by, "__span"], "left").select("__row.*", F.coalesce("__inside", "__carried")["value"].alias(name))


def lookup(asked: DataFrame, entries: DataFrame, ttl_s: int = DEFAULTS.cache_ttl_s, invalidations: DataFrame | None = None) -> DataFrame:
    """For each request (request_id, key, asked_at) the latest entry (key, cached_at, response) younger than the time to live, not void by an invalidation (at) in between: adds cached_at, response, hit. Only the last entry before a request can be alive, and only the last invalidation before it matters."""
    entry = entries.select("key", F.col("cached_at").alias("asked_at"), F.struct("cached_at", "response").alias("entry"))
    found = last_before(asked, entry, ["key"], "asked_at", "entry", "entry")
    alive = F.col("asked_at") < F.col("entry.cached_at") + F.make_dt_interval(secs=F.lit(ttl_s).cast("decimal(18,6)"))
    if invalidations is not None:
        voids = invalidations.select(F.lit(0).alias("every"), F.col("at").alias("asked_at"), F.col("at").alias("void_at"))
        found = last_before(found.withColumn("every", F.lit(0)), voids, ["every"], "asked_at", "void_at", "void_at").drop("every")
        alive = alive & (F.col("void_at").isNull() | (F.col("void_at") <= F.col("entry.cached_at")))
    hit = F.coalesce(alive, F.lit(False))
    return found.select("request_id", "key", "asked_at", F.when(hit, F.col("entry.cached_at")).alias("cached_at"), F.when(hit, F.col("entry.response")).alias("response"), hit.alias("hit"))


def _replayed(ttl_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at, keys = b.column(2).to_numpy(zero_copy_only=False), b.column(1)
            hits = np.zeros(len(at), bool)
            new = np.flatnonzero(pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)) + 1
            for start, end in zip([0, *new], [*new, len(at)], strict=True):
                if (own := keys[start].as_py()) != key or until is None:
                    key, until = own, at[start]  # the first request of a key is a miss
                while start < end:
                    to = start + int(np.searchsorted(at[start:end], until))  # all before the entry runs out
                    hits[start:to] = True
                    if to < end:
                        until = at[to] + ttl_us
                    start = to + 1
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.array(hits)], names=["event_id", "key", "hit"])

    return run


def replay(requests: DataFrame, ttl_s: int = DEFAULTS.cache_ttl_s) -> DataFrame:
    """Hit or miss of each request (event_id, key, asked_at). An entry is written on a miss only, so the window starts at the last miss.

    Requests are sorted by key and time and streamed; a key's state is the instant its
    entry runs out, and the walk jumps from miss to miss. A key is sequential by
    nature, so one task reads it, in constant memory however long it is. Requests
    without a key or a time are left out.
    """
    timed = requests.select("event_id", "key", F.unix_micros(F.col("asked_at").cast("timestamp")).alias("at")).dropna(subset=["key", "at"])
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema.fields}
    return timed.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(_replayed(ttl_s * 1_000_000), f"event_id {kinds['event_id']}, key {kinds['key']}, hit boolean")
