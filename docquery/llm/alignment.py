"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Every token points to the token of the other tokenizer that reaches farthest right
among those that overlap it. Following these pointers, doubled until nothing changes,
leads each token to the last token of its group, which names the group: places where
both tokenizers end a token cut the text into groups. All tokens of a batch are
followed at once, as arrays.

Three steps in Spark. ``align`` encodes and aligns whole texts in tasks, without a
shuffle, and deals them into blocks of some thousand documents; a block names each of
its linked id pairs once, with the number of its documents that hold it. ``pair_counts``
sums these over the corpus: what is shuffled is a row for each pair of a block, not for
each token, so a hot text or a hot pair is one row a block. ``scored`` brings the counts
back to the blocks. The aligned table is written to the shared folder between the
steps: a lost executor costs a read of it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import pieces
from docquery.llm.bpe import Recent, byte_alphabet
from docquery.sources.storage import scratch

QUERY = "op13_token_alignment"
#: Not expressible in SQL; the tests hold the query against a brute-force version over the libraries' tokens.
ORACLE_SQL = None
#: Stretches that a worker remembers: as many of the last ones, and as many of those before them.
CACHED = 200_000
#: A block of documents is closed when it has as many documents, or linked pairs.
BLOCK_DOCUMENTS = 4096
BLOCK_PAIRS = 1_000_000
#: A place where both tokenizers end a token, whatever stands around it: before a space that follows a character
#: other than white space, and after a single line feed between two such characters.
PLACES = re.compile(r"(?<=\S)(?= )|(?<=\S\n)(?=\S)")
#: Fixed value: the pre-tokenizer that PLACES holds for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Fixed value: the pattern of that pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of two tokenizers, numbered from 0 in order, from the bytes where tokens end (both rise to the same last one)."""
    n = len(a_ends)
    ends = np.concatenate([a_ends, b_ends])
    # the token of the other side that holds a token's last byte reaches farthest right among those that overlap it
    to = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)])
    own = np.arange(len(ends))
    # where both end together, the second tokenizer's token is the terminal
    to = np.where((ends[to] > ends) | (own < n), to, own)
    while True:
        twice = to[to]
        if np.array_equal(twice, to):
            break
        to = twice
    _, group = np.unique(to, return_inverse=True)  # terminals are tokens of the second tokenizer, in order
    return group[:n], group[n:]


class Aligner:
    """A byte-level vocabulary (A), a piece model (B), and the stretches that were met before."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece
        import tiktoken

        given = json.loads(vocabulary)
        own = given["model"]["vocab"]
        if given["normalizer"] or {k: given["pre_tokenizer"].get(k) for k in BYTE_LEVEL} != BYTE_LEVEL:
            raise ValueError("not a byte-level vocabulary without a normaliser")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in given["model"]["merges"]]
        if [own.get(m) for m in merged] != [*range(256, 256 + len(merged))]:
            raise ValueError("the ids of the vocabulary aren't the order of its merges")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.a_bytes = [b""] * (max(own.values()) + 1)
        special = {t["content"] for t in given["added_tokens"]}
        for t, i in own.items():
            if t not in special:
                self.a_bytes[i] = bytes(back[c] for c in t)
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if x}, special_tokens={})
        spec = pieces.proto.ModelProto.FromString(model).normalizer_spec
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.b.get_piece_size()
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not any(self.b.is_byte(i) for i in range(n)):
            raise ValueError("not a model that keeps texts as they are, puts a space in front and falls back to bytes")
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(names[i][1:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else names[i].replace(pieces.SPACE, " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        plain = [x.decode() for i, x in enumerate(self.b_bytes) if not self.b.is_byte(i)]
        # a model with pieces across these places is given whole texts
        self.whole = any("\n" in x or " " in x.lstrip(" ") for x in plain)
        self.cache = Recent(CACHED)

    def stretches(self, text: str) -> list[str]:
        """A text with the space in front, cut at places where both tokenizers end a token."""
        return [f" {text}"] if self.whole else PLACES.split(f" {text}")

    def b_ids(self, stretches: list[str]) -> list[list[int]]:
        """Ids without a space that the model puts in front: a whole text starts with one of its own; before others stands a line feed, which no piece spans, and which goes again with the space before it."""
        if self.whole:
            return self.b.encode([s[1:] for s in stretches], num_threads=1)
        return [ids[2:] for ids in self.b.encode([f"\n{s}" for s in stretches], num_threads=1)]

    def learn(self, stretches: list[str]) -> None:
        """Aligns stretches, all in one go, into the cache: (sizes, groups as text, pairs, times), or None where tokens don't give the bytes back."""
        young = self.cache.young
        a_ids, b_ids = [self.a.encode_ordinary(s) for s in stretches], self.b_ids(stretches)
        raw = [s.encode() for s in stretches]
        good = range(len(raw))
        if not b"".join(raw) == b"".join(map(self.a_bytes.__getitem__, chain.from_iterable(a_ids))) == b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b_ids))):
            good = [k for k, x in enumerate(raw) if b"".join(map(self.a_bytes.__getitem__, a_ids[k])) == x == b"".join(map(self.b_bytes.__getitem__, b_ids[k]))]
            young.update(dict.fromkeys(stretches))
            stretches, a_ids, b_ids = ([x[k] for k in good] for x in (stretches, a_ids, b_ids))
        if not stretches:
            return
        a_from, b_from = (np.append(0, np.cumsum([*map(len, x)])) for x in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        ga, gb = groups_of(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        group_from = np.append(ga[a_from[:-1]], ga[-1] + 1)
        # of each group the different ids of A times those of B; repeats are numbers
        pair, times, unit = links_of(a, ga, b, gb, np.repeat(np.arange(len(stretches)), np.diff(group_from)))
        pair_from = np.searchsorted(unit, np.arange(len(stretches) + 1))
        links = np.add.reduceat(times, pair_from[:-1])
        # the text of a group: its ids of A, a bar, its ids of B
        text = [f"{x}|{y}" for x, y in zip(runs_as_text(a, ga), runs_as_text(b, gb), strict=True)]
        sizes = np.stack([np.diff(a_from), np.diff(b_from), np.diff(group_from), links], axis=1).astype("<i8").tobytes()
        pair, times = pair.tobytes(), times.astype(np.int64, copy=False).tobytes()
        g, p = group_from.tolist(), (8 * pair_from).tolist()
        for k, s in enumerate(stretches):
            young[s] = (sizes[32 * k : 32 * k + 32], text[g[k]] if g[k + 1] == g[k] + 1 else ";".join(text[g[k] : g[k + 1]]), pair[p[k] : p[k + 1]], times[p[k] : p[k + 1]])

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """For each text: (n_a, n_b, n_groups, n_links), groups, and linked pairs with their times (pairs may repeat); None without tokens."""
        split = [self.stretches(t) if t else [] for t in texts]
        if new := self.cache.missing({s for ss in split for s in ss}):
            for at in range(0, len(new), 20_000):
                self.learn(new[at : at + 20_000])
        young, out = self.cache.young, []
        for ss in split:
            got = [*map(young.__getitem__, ss)]
            if not got or None in got:
                out.append(None)
                continue
            sizes, groups, pair, times = zip(*got, strict=True)
            out.append((np.frombuffer(b"".join(sizes), "<i8").reshape(-1, 4).sum(0), ";".join(groups), np.frombuffer(b"".join(pair), "<i8"), np.frombuffer(b"".join(times), "<i8")))
        self.cache.turn()
        return out


def links_of(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different linked pairs (a * 2**32 + b) of each unit, how often they are linked, and the unit, in its order; ``unit_of`` has the unit of each group."""

    def different(ids: np.ndarray, groups: np.ndarray):
        keys, n = np.unique((groups << 32) + ids, return_counts=True)
        return keys >> 32, keys & 0xFFFFFFFF, n

    (ga, a, na), (gb, b, nb) = different(a, ga), different(b, gb)
    b_from, n_b = np.searchsorted(gb, ga), np.bincount(gb)[ga]
    left = np.repeat(np.arange(len(a)), n_b)
    right = np.repeat(b_from - np.append(0, np.cumsum(n_b)[:-1]), n_b) + np.arange(len(left))
    pair, times, unit = (a[left] << 32) + b[right], na[left] * nb[right], unit_of[ga[left]]
    order = np.lexsort((pair, unit))
    pair, times, unit = pair[order], times[order], unit[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])))
    return pair[first], np.add.reduceat(times, first), unit[first]


def runs_as_text(ids: np.ndarray, groups: np.ndarray) -> list[str]:
    """The ids of each group, joined by commas."""
    names = [*map(str, ids.tolist())]
    bounds = [*np.searchsorted(groups, np.arange(groups[-1] + 2)).tolist()]
    return [names[x] if y == x + 1 else ",".join(names[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]


#: By digests of both files; a worker process keeps its aligner between tasks.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}

DOC = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "places": "array<int>", "times": "array<long>"}
PAIR = {"place": "int", "a": "int", "b": "int", "docs": "long"}


class Block:
    """Documents of a task until they are written out together."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.found: list = []
        self.pairs = 0

    def out(self, number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows of the documents, their pairs as places in the block's list, then that list."""
        keys = [np.zeros(0, np.int64) if f is None else f[2] for f in self.found]
        doc = np.repeat(np.arange(len(keys)), [*map(len, keys)])
        pair = np.concatenate(keys)
        times = np.concatenate([np.zeros(0, np.int64) if f is None else f[3] for f in self.found])
        known, place = np.unique(pair, return_inverse=True)
        key = doc * max(len(known), 1) + place
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        doc, place = doc[order][first], place[order][first]
        times = np.add.reduceat(times[order], first) if len(first) else times
        offsets = pa.array(np.searchsorted(doc, np.arange(len(keys) + 1)).astype(np.int32))
        sizes = np.array([np.zeros(4, np.int64) if f is None else f[0] for f in self.found]).T
        columns = [pa.array(s) for s in sizes] + [pa.array(["" if f is None else f[1] for f in self.found], pa.string())]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times))]
        kept = pa.Table.from_batches(self.rows).combine_chunks()
        n = len(keys)
        given = [c.chunk(0) if c.num_chunks else pa.nulls(0, c.type) for c in kept.columns]
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(["document"] * n, pa.string()), *given, *columns, *none], names=names)
        m = len(known)
        lists = [pa.nulls(m, t) for t in (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
        own = [pa.array(np.arange(m, dtype=np.int32)), pa.array((known >> 32).astype(np.int32)), pa.array((known & 0xFFFFFFFF).astype(np.int32)), pa.array(np.bincount(place, minlength=m))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(["pair"] * m, pa.string()), *[pa.nulls(m, c.type) for c in given], *lists, *own], names=names)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Tokens of two tokenizers over each whole text, aligned; one frame with two kinds of rows.

    ``kind`` document: the kept columns (all by default, but for ``text``), n_a, n_b,
    n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), and the linked id pairs as places
    in the list of the document's ``block``, with the times each is linked. ``kind``
    pair: place, a, b, and docs, the documents of the block that hold the pair.

    Null and empty texts, and texts whose tokens don't give their bytes back, have no
    tokens: zeros and empty lists. Very long texts are aligned whole, a document is never
    split; repeated rows are documents each; null ids pass; columns with the names above
    are replaced; an empty table gives an empty one.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        tokens = f.read()
    key, content = pieces.read_model(model)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, content))
    key = (hashlib.md5(tokens.encode()).hexdigest(), key)
    names = ["block", "kind", *DOC, *PAIR]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*names, text)]
    places = [f"c{k}" for k in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import docquery.llm.alignment as own

        if key not in own._ALIGNERS:
            own._ALIGNERS[key] = own.Aligner(*shared.value)
        aligner = own._ALIGNERS[key]
        out = ["block", "kind", *places, *own.DOC, *own.PAIR]
        number, block = TaskContext.get().partitionId() << 32, own.Block()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = aligner.batch([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                block.rows.append(part.select(range(part.num_columns - 1)) if places else part)
                block.found += found
                block.pairs += sum(len(f[2]) for f in found if f is not None)
                if len(block.found) >= own.BLOCK_DOCUMENTS or block.pairs >= own.BLOCK_PAIRS:
                    yield from block.out(number, out)
                    number, block = number + 1, own.Block()
        if block.found:
            yield from block.out(number, out)

    schema = ["block long", "kind string", *[f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(places, kept, strict=True)], *[f"{n} {k}" for n, k in (DOC | PAIR).items()]]
    given = docs.select(*[docs[f"`{c}`"].alias(p) for p, c in zip(places, kept, strict=True)], docs[f"`{text}`"].cast("string").alias("__text"))
    return given.mapInArrow(run, ", ".join(schema)).toDF("block", "kind", *kept, *DOC, *PAIR)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best) from the rows of ``align``: documents of the corpus that hold the pair linked, and whether no other pair of ``a`` has more. An id has at most as many partners as the other vocabulary has ids."""
    counts = aligned.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def scored(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """Documents of ``align`` (``columns`` of them) with n_best, the links whose pair is the best of its A id, and count_sum, the counts of all links."""
    pairs = aligned.filter("kind = 'pair'").select("block", "place", "a", "b").join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    docs = aligned.filter("kind = 'document'").select("block", "places", "times", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    kinds = [f"c{k} {aligned.schema[c].dataType.simpleString()}" for k, c in enumerate(columns)]

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        places, times = left.column("places").combine_chunks(), left.column("times").combine_chunks()
        at, n = places.flatten().to_numpy(), times.flatten().to_numpy()
        bounds = np.append(0, np.cumsum([x or 0 for x in pa.compute.list_value_length(places).to_pylist()]))

        def sums(values: np.ndarray) -> pa.Array:
            total = np.append(0, np.cumsum(values * n))
            return pa.array(total[bounds[1:]] - total[bounds[:-1]])

        own = left.select(range(left.num_columns - len(columns), left.num_columns))
        return own.append_column("n_best", sums(best[at])).append_column("count_sum", sums(count[at]))

    return docs.groupBy("block").cogroup(pairs.groupBy("of")).applyInArrow(step, ", ".join([*kinds, "n_best long", "count_sum long"])).toDF(*columns, "n_best", "count_sum")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    folder = scratch(spark, "aligned")
    align(docs, keep=["doc_id"]).withColumn("groups_sha256", F.when(F.col("kind") == "document", digest)).drop("groups").write.partitionBy("kind").parquet(folder)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return scored(spark.read.parquet(folder), columns)
