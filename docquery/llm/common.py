"""What the operators of this subpackage share: words, shared storage, let-bindings and two-level running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.sources.storage import cut, shared_folder

__all__ = ["BUCKETS", "WORD", "cut", "documents", "key_bucket", "let", "n_words", "parted", "running_total", "scan", "shared_folder", "shuffle_key"]

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits for each key of a set of keys, and of a set at most (8 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 26
#: Range buckets of a running total: each task sorts a 4096th of the largest group, not the group.
BUCKETS = 4096


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str, block: int = 512) -> Column:
    """``out(state, x)`` for every x of an array, the state going from ``start`` by ``step(state, x)``: array<``kind``>.

    Appending to an array copies it, so results are gathered in blocks: the work grows
    with the array and not with its square.
    """
    none, no_blocks = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def inside(state: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(state.alias("state"), none.alias("out")), lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(out(acc["state"], x))).alias("out")))

    def whole(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(vs), F.lit(1)) - 1) / block).cast("int")), lambda b: F.slice(vs, b * block + 1, F.lit(block)))
        each = lambda acc, xs: let(inside(acc["state"], xs), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), no_blocks.alias("out")), each, lambda acc: acc["out"]))

    return let(values, whole)


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` (no null) may be among ``keys`` (one column, read twice), and those whose key surely isn't: each row is in one of them.

    The keys become bits, which are all that is broadcast: 2 bytes a key, 8 MB at
    most, and of the keys that aren't there a sixteenth is in the first part as well
    (more where there are over 4 million). So an exact join that few rows take part in
    needs to shuffle few others.
    """
    spark, most = df.sparkSession, min(MOST_BITS, max(1 << 16, BITS_A_KEY * keys.count()))
    bits = 1 << (most - 1).bit_length()
    place = lambda c: F.xxhash64(F.lit(3), c).bitwiseAND(F.lit(bits - 1))
    at = place(F.col(f"`{keys.columns[0]}`"))
    set_ = keys.select(F.shiftright(at, 6).alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("by")).select("word", F.expr("shiftleft(one, by)").alias("mask"))
    words = set_.unionByName(spark.range(bits >> 6).select(F.col("id").alias("word"), F.expr("0L").alias("mask"))).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    rows = words.groupBy(F.shiftright("word", 10).alias("__row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("__words"))
    table = F.broadcast(cut(rows))
    own = place(key)
    word = F.get(table["__words"], F.shiftright(own, 6).bitwiseAND(F.lit(1023)).cast("int"))
    found = (F.shiftright(own, 16) == table["__row"]) & (F.getbit(word, own.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return df.join(table, found, "left_semi"), df.join(table, found, "left_anti")


def n_words(text: Column) -> Column:
    """Words of a text as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: str, *columns: Column) -> Column:
    """32 hex digits that order rows as a seeded shuffle would, the same in every run and in SQL (md5)."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))


def key_bucket(key: Column) -> Column:
    """Range bucket 0..4095 of a shuffle key: its first three hex digits."""
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group that come before this one.

    Rows come by ``bucket`` (a range bucket that agrees with ``order``), then by
    ``order``. A window over a whole group would put a hot source in one task;
    here totals of buckets are summed first (partial sums before the shuffle), and
    a window only orders the rows of one bucket. Null group values are a group.
    """
    df = df.withColumn("__v", value)
    small = df.groupBy(*group, bucket).agg(F.sum("__v").alias("__in_bucket"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*[F.col(c).alias(f"__{c}") for c in [*group, bucket]], F.coalesce(F.sum("__in_bucket").over(before), F.lit(0)).alias("__before"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, bucket]]
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(small, on, "inner").drop(*[f"__{c}" for c in [*group, bucket]])
    return joined.withColumn(name, F.col("__before") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__v", "__before")
