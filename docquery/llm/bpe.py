"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of a word. A token sequence is the one that
merging by rank would give if and only if every adjacent pair is compatible, that is
if merging the pair's own characters gives that pair; so all adjacent pairs of a batch
are tested at once, by lookup in a sorted array of pairs already known. Only words
with an incompatible pair undergo exact merging.

Spark deals out the texts; a task encodes an Arrow batch at a time and shuffles
nothing. Words that were met before come from a cache of bounded size. The vocabulary
is read from a file whose path is a parameter and sent to tasks as a broadcast
variable: its size is that of the file, whatever the input.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

QUERY = "op7_bpe_roundtrip"
ORACLE_SQL = None
#: Chunks between white space, and words, that a task remembers: as many of the last ones, and as many of those before them.
CACHED = 100_000
CACHED_WORDS = 200_000
#: Pairs of tokens whose compatibility a worker remembers, at most.
TESTED_PAIRS = 4_000_000
#: Fixed value: the white space of the vocabulary's pattern \s (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
#: Characters that str.split() takes as white space and the pattern doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Recent:
    """A cache in two generations: what is used moves to the young one; when that is full, the old one is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that are in neither generation; the others are in ``young`` from here on, until ``turn``."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


class Encoder:
    """A word-end BPE vocabulary (a tokenizer file in JSON) and what has been learnt about it so far."""

    def __init__(self, file: str):
        model = json.loads(file)
        bpe, steps = model["model"], model["normalizer"]["normalizers"]
        if bpe["type"] != "BPE" or not bpe["end_of_word_suffix"] or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word-end BPE vocabulary with NFC, white space and lower case")
        self.suffix = bpe["end_of_word_suffix"]
        self.ids: dict[str, int] = bpe["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.none = (len(pairs), -1)  # what a pair without a merge has for (rank, token)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(self.suffix)}
        self.final = {t[: -len(self.suffix)]: i for t, i in self.ids.items() if t.endswith(self.suffix)}
        self.longest = max(map(len, self.final))
        self.reach: dict[str, int] = {}  # the longest inner token by its first two characters
        for t in self.inner:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.parts = {i: t for t, i in self.inner.items()} | {i: t for t, i in self.final.items()}
        self.ends = set(self.final.values())
        self.known = np.empty(0, np.int64)  # sorted keys of tested pairs, and whether they are compatible
        self.good = np.empty(0, bool)
        self.cache, self.word_cache = Recent(CACHED), Recent(CACHED_WORDS)

    def merged(self, chars: str, end: bool) -> list[int]:
        """Exact merging of a word's characters: always the pair of lowest rank, the leftmost first."""
        n = len(chars)
        ids = [self.inner[c] for c in chars]
        if end:
            ids[-1] = self.final[chars[-1]]
        return self.merged_long(ids) if n > 40 else self.merged_short(ids)

    def merged_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, self.none
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found))[1] >= 0:
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """As ``merged_short``; a heap keeps it near linear for very long words."""
        n = len(ids)
        before, after, heap = [*range(-1, n - 1)], [*range(1, n), -1], []
        for k in range(n - 1):
            if m := self.merges.get((ids[k], ids[k + 1])):
                heap.append((m[0], k, ids[k], ids[k + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if m := self.merges.get((new, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, new, ids[after[k]], m[1]))
            if (p := before[k]) >= 0 and (m := self.merges.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [i for i in ids if i >= 0]

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match."""
        out, at, n, inner, final, reach = [], 0, len(word), self.inner, self.final, self.reach
        while at < n:
            if n - at <= self.longest and (i := final.get(word[at:])) is not None:
                out.append(i)
                break
            for to in range(min(n - 1, at + reach.get(word[at : at + 2], 1)), at, -1):
                if (i := inner.get(word[at:to])) is not None:
                    out.append(i)
                    at = to
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Of pairs of tokens, as a * 2**32 + b (a = -1: b alone): whether merging their characters gives them back."""
        new = np.setdiff1d(keys, self.known)
        if len(self.known) + len(new) > TESTED_PAIRS:  # begin anew: pairs are tested again as they come
            self.known, self.good = np.empty(0, np.int64), np.empty(0, bool)
            new = np.unique(keys)
        if len(new):
            good = []
            for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True):
                chars = (self.parts[a] if a >= 0 else "") + self.parts[b]
                good.append(self.merged(chars, b in self.ends) == ([a, b] if a >= 0 else [b]))
            at = np.searchsorted(self.known, new)
            self.known, self.good = np.insert(self.known, at, new), np.insert(self.good, at, good)
        return self.good[np.searchsorted(self.known, keys)]

    def words(self, words: list[str]) -> list[list[int]]:
        """Tokens of words (characters of the byte alphabet): proposals, of which those with an incompatible pair are merged exactly."""
        out = [self.proposed(w) for w in words]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for ids in out for i in ids), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(out)), lengths)
        pair = word[1:] == word[:-1]
        alone = np.flatnonzero(lengths == 1)
        first = np.cumsum(lengths) - lengths
        keys = np.concatenate([(flat[:-1][pair] << 32) + flat[1:][pair], (np.int64(-1) << 32) + flat[first[alone]]])
        of = np.concatenate([word[1:][pair], alone])
        for k in np.unique(of[~self.compatible(keys)]) if len(keys) else ():
            out[k] = self.merged(words[k], True)
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks (runs without white space) into the cache: their ids as bytes, and their tokens joined as decoding joins them."""
        pieces = [self.pattern.findall(lower(c if c.isascii() else unicodedata.normalize("NFC", c))) for c in chunks]
        own = self.word_cache
        if new := own.missing({p for ps in pieces for p in ps}):
            letters = self.alphabet
            for p, ids in zip(new, self.words(["".join([letters[b] for b in p.encode()]) for p in new]), strict=True):
                own.young[p] = (np.array(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids]))
        known, young = own.young, self.cache.young
        for c, ps in zip(chunks, pieces, strict=True):
            if len(ps) == 1:
                young[c] = known[ps[0]]
            else:
                got = [known[p] for p in ps]
                young[c] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        own.turn()

    def parts_of(self, text: str) -> list[str]:
        """Chunks and special tokens of a text, in order."""
        if self.split_special and "<" in text and self.split_special.search(text):
            return [x for k, s in enumerate(self.split_special.split(text)) for x in ([s] if k % 2 else self.chunks(s))]
        return self.chunks(text)

    @staticmethod
    def chunks(text: str) -> list[str]:
        return [x for x in _SPACES.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text: its ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        parts = [self.parts_of(t) for t in texts]
        young = self.cache.young
        young.update({t: (np.array([i], "<u4").tobytes(), t) for t, i in self.special.items()})
        self.learn(self.cache.missing({p for ps in parts for p in ps}))
        out = []
        for ps in parts:
            got = [*map(young.__getitem__, ps)]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        self.cache.turn()
        return out


def lower(text: str) -> str:
    """Lower case character by character: a final sigma is no special case."""
    return text.replace("Σ", "σ").lower()


#: By digest of the vocabulary file; a worker process keeps its encoder between tasks.
_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", *, ids: bool = True, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds to each row the tokens of its whole text; null text is empty.

    ``ids``: adds token_ids (array<int>) and decoded (string). ``digests``: adds
    n_tokens, ids_sha256 and decoded_sha256 instead of or beside them. ``keep``: the
    columns that pass through, all by default; columns with the new names are
    replaced. No row is dropped or moved, repeated rows are encoded each.
    """
    names = (["token_ids", "decoded"] if ids else []) + (["n_tokens", "ids_sha256", "decoded_sha256"] if digests else [])
    kinds = {"token_ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        content = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    key = hashlib.md5(content.encode()).hexdigest()
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import docquery.llm.bpe as own

        if key not in own._ENCODERS:
            own._ENCODERS[key] = Encoder(shared.value)
        coder = own._ENCODERS[key]
        for b in batches:
            # a few hundred texts at a time: memory follows them, not the batch
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = coder.batch([t or "" for t in part.column(part.schema.get_field_index("__text")).to_pylist()])
                new = {}
                if ids:
                    new["token_ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
                    new["decoded"] = pa.array([d for _, d in got], pa.string())
                if digests:
                    new["n_tokens"] = pa.array([len(x) // 4 for x, _ in got], pa.int64())
                    new["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x, _ in got], pa.string())
                    new["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *(new[n] for n in names)], names=[*kept, *names])

    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema.fields if c.name in kept)
    return docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].cast("string").alias("__text")).mapInArrow(run, ", ".join(x for x in [schema, *(f"{n} {kinds[n]}" for n in names)] if x))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, ids=False, digests=True, keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
