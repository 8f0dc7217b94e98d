"""Near duplicates by the Jaccard similarity of their word shingles, found exactly.

Two sets of shingles that are similar enough share one of their first few shingles in
any fixed order of all shingles (prefix filter): here those first that a sample of
documents doesn't know as frequent. Their sizes say how many they must share at least.
Pairs that do are joined (in a very long list all that follow each other by size, as if
they did), which gives groups that no similar pair crosses.
Inside its group each set is compared with all that can be similar to it, by whole
sets. Large groups are dealt as pairs of hashed blocks, so no task holds more than two
blocks. Tasks report what spans their links, never all pairs.

The order decides only how large groups get, not what is found. Frequent shingles of
the sample (``FREQUENT`` at most) go to the driver, and sets of keys as bits
(``parted``): texts and prefixes are shuffled only where such a bit says that they may
be grouped, dropped or repeated, and pass where they are otherwise. Tables that grow
with the input are never broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import parted
from docquery.llm.components import components
from docquery.sources.storage import removed, scratch

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Documents that frequent shingles are counted in and shingles that are kept of them, at most; a shingle in so many of those documents is frequent.
SAMPLE, FREQUENT, OFTEN = 1 << 14, 1 << 18, 3
#: A list of so many sets is compared pair by pair.
LIST = 64
#: Sets and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 2000, 1 << 20


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 values of a text's runs of ``k`` words, in order; fewer words are one run of all of them. No words: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, n))


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set shares one: the first of ``own``, frequent ones (sorted, with their ranks) last."""
    n = len(own)
    if not n:
        return own
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        often = frequent[at] == own
        own = np.concatenate((own[~often], own[often][np.argsort(rank[at[often]])]))
    return own[: n + (-NUM * n // DEN) + 1]


def link(sets: list[np.ndarray]) -> np.ndarray:
    """Position of the root of each set: all that are similar, directly or by steps, share one."""
    up = list(range(len(sets)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    size = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.concatenate(([0], np.cumsum(size)))
    if not begin[-1]:
        return np.zeros(len(sets), np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ordered = np.lexsort((flat, counts[flat], owner))
    place = np.arange(begin[-1]) - begin[owner]
    first = ordered[place < (size + (-NUM * size // DEN) + 1)[owner]]
    first = first[counts[flat[first]] > 1]
    first = first[np.lexsort((owner[first], flat[first]))]
    token, holder = flat[first], owner[first]
    cuts = np.searchsorted(token, np.arange(len(counts) + 1))
    marked = np.zeros(len(counts), bool)
    roots = np.arange(len(sets))
    by_holder = np.argsort(holder, kind="stable")
    bounds = np.searchsorted(holder[by_holder], np.arange(len(sets) + 1))
    for x in range(len(sets)):
        own = token[by_holder[bounds[x] : bounds[x + 1]]]
        lists = [found for t in own.tolist() if len(found := holder[cuts[t] : cuts[t + 1]]) > 1]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[(near < x) & (DEN * np.minimum(size[near], size[x]) >= NUM * np.maximum(size[near], size[x]))]
        near = near[roots[near] != roots[x]]
        if not len(near):
            continue
        marked[flat[begin[x] : begin[x + 1]]] = True
        some = size[near]
        at = np.repeat(begin[near] - np.concatenate(([0], np.cumsum(some)[:-1])), some) + np.arange(some.sum())
        shared = np.add.reduceat(marked[flat[at]].astype(np.int64), np.concatenate(([0], np.cumsum(some)[:-1])))
        marked[flat[begin[x] : begin[x + 1]]] = False
        joined = near[DEN * shared >= NUM * (some + size[x] - shared)]
        for y in joined.tolist():
            a, b = root(x), root(y)
            up[max(a, b)] = min(a, b)
        if len(joined):
            old = np.unique(np.append(roots[joined], roots[x]))
            roots[np.isin(roots, old)] = old[0]
    return np.fromiter(map(root, up), np.int64, len(up))


def _frequent(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, rank): frequent ones of a sample of documents, sorted, with their places by frequency."""
    n = texts.count()
    some = texts if n <= SAMPLE else texts.filter(F.pmod(F.xxhash64(F.lit(7), "__g"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 200) for at in range(0, b.num_rows, 200)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, k) for t in part.column(0).to_pylist()]).view(np.int64))], names=["h"])

    counts = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    found = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - 1 - np.arange(len(found)))[order]


def _prints(keyed: DataFrame, k: int, sketch: Callable[[np.ndarray], int] | None) -> DataFrame:
    """(doc_id, __h, __g, fp, n, first, sim): digest and size of each row's set, its prefix and its sketch."""
    frequent, rank = _frequent(keyed, k)
    names = ["doc_id", "__h", "__g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 200) for at in range(0, b.num_rows, 200)):
                sets = [shingles(t, k) for t in part.column(3).to_pylist()]
                fps = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
                first = pa.array([prefix(s, frequent, rank).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), first, pa.array(np.fromiter(map(sketch, sets), np.uint64, len(sets)).view(np.int64) if sketch else fps)], names=[*names, "fp", "n", "first", "sim"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select(*names, F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, __h long, __g long, fp long, n int, first array<long>, sim long")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, fp, c) sorted, to (a, b, need): pairs of a list whose classes ``c`` differ (0: a class of its own) and whose sizes can be similar, and how many shingles of both prefixes they must share for it. Of a list longer than ``LIST`` only those that follow each other, unconditionally."""

    def out(h: np.ndarray, n: np.ndarray, fp: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(h)) + 1
        length = np.diff(np.concatenate(([0], cuts, [len(h)])))
        long_ = np.repeat(length > LIST, length)
        found = []
        for d in range(1, min(LIST, len(h))):
            on = h[d:] == h[:-d]
            if not on.any():
                break
            at = np.flatnonzero(on & ((c[d:] != c[:-d]) | (c[d:] == 0)) & (DEN * n[:-d] >= NUM * n[d:]) & ((d == 1) | ~long_[d:]))
            x, y = n[at], n[at + d]
            shared = -(-NUM * (x + y) // (NUM + DEN))
            need = np.where(long_[at], 0, shared + (-NUM * np.maximum(x, y) // DEN) + 1)
            found.append((np.minimum(fp[at], fp[at + d]), np.maximum(fp[at], fp[at + d]), need))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "need"])

    left = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        left = [np.concatenate((x, c.to_numpy(zero_copy_only=False).astype(np.int64))) for x, c in zip(left, batch.columns, strict=True)]
        if len(left[0]):
            whole = np.searchsorted(left[0], left[0][-1])  # the last list may go on
            if whole:
                yield out(*(c[:whole] for c in left))
                left = [c[whole:].copy() for c in left]
    if len(left[0]):
        yield out(*left)


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, p, q, fp, set) sorted by the first three, to (a, b): forests of what is similar. Small groups are compared together."""
    fps, sets, at, total = [], [], None, 0

    def out() -> pa.RecordBatch:
        own, where = np.unique(np.array(fps, np.int64), return_index=True)
        up = link([sets[i] for i in where.tolist()])
        child = np.flatnonzero(up != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(own[child]), pa.array(own[up[child]])], names=["a", "b"])

    for batch in batches:
        values, ends = batch.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(4).value_lengths().to_numpy(zero_copy_only=False).cumsum()
        for key, fp, end, start in zip(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True), batch.column(3).to_pylist(), ends.tolist(), [0, *ends[:-1].tolist()], strict=True):
            if key != at and (len(fps) > BLOCK_SETS or total > BLOCK_SHINGLES):
                yield out()
                fps, sets, total = [], [], 0
            at = key
            fps.append(fp)
            sets.append(values[start:end].copy())
            total += end - start
    if fps:
        yield out()


def _linked(keyed: DataFrame, prints: DataFrame, twice: DataFrame, k: int, tree: Callable[[DataFrame], DataFrame] | None, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Edges (a, b) among digests of sets that span what is similar. Sets whose sketches ``tree`` links are one class and candidates; prefixes are only joined across classes. ``twice``: digests of several rows."""
    sims = stored(prints.select(F.col("sim").alias("fp")).distinct(), "sims")
    near = sims.select(F.col("fp").alias("sim"), F.col("fp").alias("c")).limit(0) if tree is None else components(tree(sims)).select(F.col("v").alias("sim"), F.col("root").alias("c"))
    near = stored(near, "near")
    # the class of every set that has one; a set that shares its class with no other is in none
    sets = prints.select("fp", "sim").distinct().join(near.hint("merge"), "sim", "left").select("fp", F.coalesce("c", "sim").alias("c"))
    first = sets.groupBy("c").agg(F.min("fp").alias("b"), F.count("*").alias("sets")).filter("sets > 1")
    together = stored(sets.join(first.hint("merge"), "c").select(F.col("fp").alias("a"), "b", "c"), "together")
    special = stored(twice.select("fp").unionByName(together.select(F.col("a").alias("fp"))).distinct(), "special")
    some, others = parted(prints.select("fp", "n", "first"), F.col("fp"), special.select("fp"))
    some = some.dropDuplicates(["fp"]).join(together.select(F.col("a").alias("fp"), "c").hint("merge"), "fp", "left")
    classed = others.withColumn("c", F.lit(0).cast("long")).unionByName(some.withColumn("c", F.coalesce("c", F.lit(0))))
    lists = classed.select(F.explode("first").alias("h"), "n", "fp", "c")
    pairs = lists.repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(_candidates, "a long, b long, need long")
    across = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")
    groups = stored(components(together.select("a", "b").unionByName(across)).withColumnRenamed("v", "fp"), "groups")
    # one row stands for all of its set
    held, _ = parted(prints.select("fp", "n", "__h", "__g"), F.col("fp"), groups.select("fp"))
    one = held.groupBy("fp").agg(F.min(F.struct("__h", "__g", "n")).alias("x")).select("fp", "x.*")
    grouped = stored(one.join(groups.hint("merge"), "fp"), "grouped")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    placed = stored(grouped.join(grouped.groupBy("root").agg(blocks.alias("blocks")).hint("merge"), "root").select("__h", "__g", "fp", "root", "blocks"), "placed")
    texts, _ = parted(keyed.select("__h", "__g", F.col("text").cast("string").alias("text")), F.col("__h"), placed.select("__h"))
    chosen = texts.join(placed.hint("merge"), ["__h", "__g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 200) for at in range(0, b.num_rows, 200)):
                sets = pa.array([shingles(t, k).view(np.int64) for t in part.column(3).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sets], names=["fp", "root", "blocks", "own"])

    sets = chosen.select("fp", "root", "blocks", "text").mapInArrow(run, "fp long, root long, blocks int, own array<long>")
    mine, other = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("root", mine.alias("mine"), other.alias("other"), "fp", "own").select("root", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp", "own")
    return dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(_link_blocks, "a long, b long")


def keep_one(docs: DataFrame, k: int = SHINGLE, sketch: Callable[[np.ndarray], int] | None = None, tree: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class one row with its smallest id stays (null ids only where there are no others).

    Texts are near if the distinct runs of ``k`` words of one are 0.8 similar to those
    of the other, directly or by steps. Texts without words are near to each other.
    Rows are told apart by two 64-bit hashes of id and text; rows equal in both are
    repeated rows, of which one stays. ``sketch`` gives 64 bits of a set; ``tree``
    links distinct ones (fp) that differ little, as edges (a, b). Neither decides what
    is near: what they bring together is compared by whole sets.

    Prefixes are written once; the steps between are files that go when the rows to
    drop are known, and rows that are neither dropped nor repeated are not shuffled.
    """
    names, spark = docs.columns, docs.sparkSession
    folder = scratch(spark, "similar")

    def stored(df: DataFrame, name: str, kept: str = "steps") -> DataFrame:
        df.write.parquet(f"{folder}/{kept}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{kept}/{name}")

    keyed = docs.withColumns({"__h": F.xxhash64("doc_id", "text"), "__g": F.xxhash64(F.lit(1), "text", "doc_id")})
    prints = stored(_prints(keyed, k, sketch), "prints")
    twice = stored(prints.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    roots = stored(components(_linked(keyed, prints, twice, k, tree, stored)).withColumnRenamed("v", "fp"), "roots")
    # rows of sets of one row that nothing is near to stay; of the others one of each class
    marked = stored(twice.select("fp").unionByName(roots.select("fp")).distinct(), "marked")
    some, _ = parted(prints.select("doc_id", "__h", "__g", "fp"), F.col("fp"), marked)
    rooted = stored(some.join(roots.hint("merge"), "fp", "left").select("doc_id", "__h", "__g", F.coalesce("root", "fp").alias("root")), "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "__g")).alias("first")
    stay = rooted.groupBy("root").agg(first).select("first.__h", "first.__g")
    gone = stored(rooted.select("__h", "__g").distinct().join(stay.hint("merge"), ["__h", "__g"], "left_anti"), "gone", "kept")
    repeated = rooted.groupBy("__h", "__g").count().filter("count > 1")
    asked = stored(gone.select("__h").unionByName(repeated.select("__h")).distinct(), "asked")
    may, others = parted(keyed, F.col("__h"), asked)
    removed(spark, f"{folder}/steps")
    may = may.join(gone.hint("merge"), ["__h", "__g"], "left_anti").dropDuplicates(["__h", "__g"])
    return others.select(*names).unionByName(may.select(*names))
