"""SentencePiece encoding and decoding with byte spans in the original text.

Normalising takes the longest prefix that the model's compiled character map knows
(characters that it doesn't know stay), and records for each normalised byte where it
came from. Pieces are merged on the normalised text, best score first, a merge of each
of some thousand stretches at a time; each piece is then projected through that record
to its span of bytes in the original.

Spark deals out the texts; a task encodes a few hundred at a time and shuffles nothing,
so a lost executor costs its tasks only. Merges never cross a place that no piece of the
vocabulary spans, so stretches between such places are encoded once and remembered in a
cache of bounded size. The model is read from a file whose path is a parameter and sent
to tasks as a broadcast variable: its size is that of the file, whatever the input.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from docquery.llm.bpe import Recent

QUERY = "op12_piece_encoding"
#: Not expressible in SQL; the tests hold the query against the sentencepiece library.
ORACLE_SQL = None
#: Stretches that a task remembers: as many of the last ones, and as many of those before them.
CACHED = 200_000
#: What a space becomes (U+2581).
SPACE = "▁"
#: Symbols of a stretch from which a heap of pairs is used.
LONG = 48
#: Stretches that are merged together: at least so many, fewer are merged one by one, and at most so many.
TOGETHER = 48, 16384


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """A compiled character map: a double-array trie of byte strings, whose values point to what replaces them."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replaced = compiled[4 + size :]
        self.known: dict[str, tuple[int, str] | None] = {}
        self.extends: dict[str, bool] = {}

    def walk(self, key: bytes) -> tuple[int, int, bool]:
        """The longest prefix of ``key`` in the trie (its length, 0 for none), its value, and whether the trie goes on after the whole key."""
        units, length, value = self.units, 0, 0
        at = units[0] >> 10 << ((units[0] & 0x200) >> 6)
        for k, c in enumerate(key):
            at ^= c
            if at >= len(units) or units[at] & 0x800000FF != c:
                return length, value, False
            unit = units[at]
            at ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                length, value = k + 1, units[at] & 0x7FFFFFFF
        return length, value, True

    def longest(self, text: str, at: int) -> tuple[int, str]:
        """Number of characters taken at ``at``, and what they become: the longest prefix of the map, or one character as it is."""
        to, pair = at + 1, text[at : at + 2]
        if pair not in self.extends:
            self.extends[pair] = len(pair) == 2 and self.walk(pair.encode())[2]
        if self.extends[pair]:
            to = at + 2
            while to < len(text) and self.walk(text[at:to].encode())[2]:
                to += 1
        key = text[at:to]
        if len(key) == 2 and not self.extends[pair]:
            key = key[0]
        if key in self.known:
            return self.known[key]
        # a pair can be an entry itself without going on
        length, value, _ = self.walk((key if len(key) > 1 else pair).encode())
        if length:
            taken = len((key if len(key) > 1 else pair).encode()[:length].decode())
            found = taken, self.replaced[value : self.replaced.index(b"\0", value)].decode()
        else:
            found = 1, text[at]
        return found


class Pairs:
    """Pairs of pieces that make a piece, as a table with open addressing: arrays of pairs are looked up at once."""

    NONE = np.int64(1) << 62  # the rank of a pair that makes no piece
    BITS = 32  # below a rank: the place of a pair

    def __init__(self, piece: dict[str, tuple[float, int]]):
        self.base = max([i for _, i in piece.values()], default=0) + 2  # one more than there are: the id beside the ends of a stretch
        scores = np.unique([score for score, _ in piece.values()])
        made = [(piece[a][1], piece[b][1], *found) for p, found in piece.items() for k in range(1, len(p)) if (a := p[:k]) in piece and (b := p[k:]) in piece]
        left, right, score, to = (np.array(x) for x in zip(*made, strict=True)) if made else (np.empty(0, np.int64),) * 4
        keys = left * self.base + right
        self.shift = 64 - max(4, (4 * len(keys)).bit_length())
        size = 1 << 64 - self.shift
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, self.NONE), np.full(size, -1, np.int32)
        at, todo = self.slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) % size
        self.ranks[at] = np.searchsorted(scores, score) << self.BITS  # equal scores have one rank
        self.made[at] = to
        # characters that are pieces, by code point; the last one stands for all above
        alone = {ord(p): i for p, (_, i) in piece.items() if len(p) == 1}
        self.alone = np.full(max(alone, default=0) + 2, -1, np.int32)
        self.alone[[*alone]] = [*alone.values()]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs are in the table; pairs that make no piece are at an empty place."""
        keys = left.astype(np.int64) * self.base + right
        at = self.slots(keys)
        there = self.keys[at]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.keys)
            there = self.keys[at[other]]
            other = other[(there != keys[other]) & (there >= 0)]
        return at

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many stretches, given the pieces that are their characters, and how many each has: in each round every stretch merges its pair of the best score, the leftmost first."""
        n = len(symbols)
        starts = np.cumsum(sizes) - sizes
        # n stands beside the first and the last symbol of a stretch
        symbols = np.append(symbols, np.int32(self.base - 1))
        before, after, best = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32), np.full(n + 1, self.NONE)
        before[starts], after[starts + sizes - 1] = n, n
        makes = self.find(symbols[:-1], symbols[after[:-1]])
        best[:-1] = self.ranks[makes] + np.arange(n)
        alive = np.ones(n, bool)
        going = starts
        while len(going):
            # a stretch that is done has no pair left, and counts for nothing in the range of the one before
            found = np.minimum.reduceat(best, going)
            go = found < self.NONE
            going, found = going[go], found[go]
            at = found & ((1 << self.BITS) - 1)
            gone = after[at]
            symbols[at] = self.made[makes[at]]
            alive[gone], best[gone] = False, self.NONE
            after[at] = after[gone]
            before[after[at]] = at
            left = np.concatenate([at, before[at]])
            here = self.find(symbols[left], symbols[np.concatenate([after[at], at])])
            best[left] = self.ranks[here] + left
            left, here = left[left < n], here[left < n]
            makes[left] = here
        return symbols[:-1][alive], np.add.reduceat(alive, starts, dtype=np.int64)


class Encoder:
    """A BPE model file of the library, and the stretches that were met before."""

    def __init__(self, model: bytes):
        m = proto.ModelProto()
        m.ParseFromString(model)
        kinds = proto.ModelProto.SentencePiece
        if m.trainer_spec.model_type != proto.TrainerSpec.BPE or m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("not a BPE model with escaped spaces before words")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        spec = m.normalizer_spec
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.names = [p.piece for p in m.pieces]
        self.piece = {p.piece: (-p.score, i) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        byte_ids = [i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in byte_ids} if m.trainer_spec.byte_fallback else {}
        self.none = (float("inf"), -1)
        self.pairs = Pairs(self.piece)
        self.covers = np.array([len(name.encode()) for name in self.names], np.int32)
        self.surface = [(p.piece.replace(SPACE, " ") if p.type == kinds.NORMAL else m.trainer_spec.unk_surface if p.type == kinds.UNKNOWN else "").encode() for p in m.pieces]
        self.control = {i for i, p in enumerate(m.pieces) if p.type == kinds.CONTROL}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        # places that no piece spans: before a space that follows another character, and around characters of no piece
        lone = "".join(c for c in map(chr, range(32)) if not any(c in p for p in self.piece))
        crossed = any(SPACE in p.lstrip(SPACE) for p in self.piece)
        own = re.escape(lone)
        self.stretch = re.compile("(?s).+" if crossed else f"{SPACE}+[^{SPACE}{own}]*|[{own}]|[^{SPACE}{own}]+" if lone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cache = Recent(CACHED)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes, and its end, the byte of ``text`` that it stands at."""
        if self.map is None and not self.squeeze:
            raw = np.frombuffer(text.encode(), np.uint8)
            grown = np.where(raw == 32, 3, 1)
            align = np.repeat(np.arange(len(raw), dtype=np.int32), grown)
            head = np.zeros(3 if self.prefix and text else 0, np.int32)
            return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE), np.concatenate([head, align, np.array([len(raw)], np.int32)])
        out: list[str] = []
        sizes: list[int] = []  # normalised bytes of each step, and where the step starts
        starts: list[int] = []
        at, byte, n = 0, 0, len(text)
        after_space = self.squeeze
        first = True
        while at < n:
            taken, new = self.map.longest(text, at) if self.map else (1, text[at])
            came = byte
            byte += len(text[at : at + taken].encode())
            at += taken
            if first:
                if self.squeeze and new == " ":  # leading spaces go before the prefix is set
                    continue
                first = False
                if self.prefix:
                    out.append(SPACE)
                    sizes.append(3)
                    starts.append(came)
            if after_space:
                new = new.lstrip(" ")
            if new:
                new_text = new.replace(" ", SPACE)
                out.append(new_text)
                sizes.append(len(new_text.encode()))
                starts.append(came)
                after_space = self.squeeze and new.endswith(" ")
        end = byte
        if self.squeeze:
            while out and out[-1].endswith(SPACE):
                out[-1] = out[-1][: -len(SPACE)]
                sizes[-1] -= 3
                end = starts[-1]
                if not out[-1]:
                    out.pop()
                    sizes.pop()
                    starts.pop()
        align = np.append(np.repeat(np.array(starts, np.int32), sizes), np.int32(end)) if out else np.zeros(1, np.int32)
        return "".join(out), align

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after merging: always the pair of the best score, the leftmost first."""
        if len(symbols) > LONG:
            return self.merged_long(symbols)
        get, none = self.piece.get, self.none
        found = [get(a + b, none)[0] for a, b in zip(symbols, symbols[1:], strict=False)]
        worst = none[0]
        while found and (best := min(found)) < worst:
            k = found.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del found[k]
            if k:
                found[k - 1] = get(symbols[k - 1] + symbols[k], none)[0]
            if k < len(found):
                found[k] = get(symbols[k] + symbols[k + 1], none)[0]
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """As ``merged``; a heap keeps it near linear for very long stretches."""
        n = len(symbols)
        before, after, heap = [*range(-1, n - 1)], [*range(1, n), -1], []
        for k in range(n - 1):
            if m := self.piece.get(symbols[k] + symbols[k + 1]):
                heap.append((m[0], k, len(symbols[k]) + len(symbols[k + 1])))
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            j = after[k]
            if not symbols[k] or j < 0 or len(symbols[k]) + len(symbols[j]) != size:
                continue
            symbols[k], symbols[j], after[k] = symbols[k] + symbols[j], "", after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (m := self.piece.get(symbols[a] + symbols[b])):
                    heapq.heappush(heap, (m[0], a, len(symbols[a]) + len(symbols[b])))
        return [s for s in symbols if s]

    def learn(self, stretches: list[str]) -> None:
        """Puts what ``encoded`` gives for stretches into the cache: ordinary ones merged together, long ones and those with characters of no piece one by one."""
        least, most = TOGETHER
        young = self.cache.young
        short = [s for s in stretches if len(s) <= LONG]
        if len(short) < least:
            young.update(zip(stretches, map(self.encoded, stretches), strict=True))
            return
        young.update((s, self.encoded(s)) for s in stretches if len(s) > LONG)
        for k in range(0, len(short), most):
            part = short[k : k + most]
            codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4")
            symbols = self.pairs.alone[np.minimum(codes, len(self.pairs.alone) - 1)]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            whole = np.minimum.reduceat(symbols, np.cumsum(sizes) - sizes) >= 0
            if not whole.all():
                young.update((s, self.encoded(s)) for s, w in zip(part, whole.tolist(), strict=True) if not w)
                part = [s for s, w in zip(part, whole.tolist(), strict=True) if w]
                symbols, sizes = symbols[np.repeat(whole, sizes)], sizes[whole]
            if part:
                ids, counts = self.pairs.merged(symbols, sizes)
                raw = np.stack([ids, self.covers[ids]], axis=1).astype("<i4", copy=False).tobytes()
                ends = (8 * np.cumsum(counts)).tolist()
                young.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encoded(self, stretch: str) -> bytes:
        """Ids of a stretch, after each the normalised bytes that it covers; of a character's byte pieces the last one covers it."""
        ids: list[int] = []
        sizes: list[int] = []
        for s in self.merged(list(stretch)):
            found, raw = self.piece.get(s), s.encode()
            if found:
                ids.append(found[1])
                sizes.append(len(raw))
            elif self.bytes:
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return np.array([ids, sizes], "<i4").T.tobytes()

    def batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and the spans of bytes in the text (starts, ends)."""
        normal = [self.normalise(t) for t in texts]
        split = [self.stretch.findall(t) for t, _ in normal]
        cache = self.cache
        young = cache.young
        self.learn(cache.missing(set().union(*split).difference(young)))
        out = []
        for ss, (_, align) in zip(split, normal, strict=True):
            got = np.frombuffer(b"".join(map(young.__getitem__, ss)), "<i4")
            ids, sizes = got[::2], got[1::2]
            if not self.bytes and (ids == self.unknown).any():
                ids, sizes = self.joined_unknown(ids, sizes)
            ends = np.cumsum(sizes)
            out.append((ids, align[ends - sizes], align[ends]))
        cache.turn()
        return out

    def joined_unknown(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring unknown pieces are one."""
        lost = ids == self.unknown
        first = np.flatnonzero(~(lost & np.append(False, lost[:-1])))
        return ids[first], np.add.reduceat(sizes, first)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces back, the prefix off, byte pieces joined; bytes that are no UTF-8 become U+FFFD each."""
        surface, strip = self.surface, self.prefix or self.squeeze
        at = 0
        lead = b""
        while strip and at < len(ids) and not lead and ids[at] not in self.byte_of:
            piece = surface[ids[at]]
            if self.names[ids[at]].startswith(SPACE):
                lead, strip = piece[1:], self.squeeze
            else:
                lead = piece
            at += 1
        rest = ids[at:]
        if self.control.isdisjoint(rest):  # a control piece ends a run of bytes
            try:
                return (lead + b"".join([surface[i] for i in rest])).decode()
            except UnicodeDecodeError:
                pass
        return lead.decode() + "".join(self.decoded_runs(rest))

    def decoded_runs(self, ids: list[int]) -> Iterator[str]:
        run = b""
        for i in [*ids, -1]:
            if i in self.byte_of:
                run += self.surface[i]
                continue
            while run:
                n = 1 if run[0] < 0x80 else 2 if run[0] >> 5 == 6 else 3 if run[0] >> 4 == 14 else 4
                try:
                    yield run[:n].decode()
                    run = run[n:]
                except UnicodeDecodeError:
                    yield "�"
                    run = run[1:]
            if i >= 0:
                yield self.surface[i].decode()


#: By digest of the model file; a worker process keeps its encoder between tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, model: bytes) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def read_model(model: str | None) -> tuple[str, bytes]:
    """The content of a model file and its digest."""
    with open(model or default_model(), "rb") as f:
        content = f.read()
    return hashlib.md5(content).hexdigest(), content


NEW = {"piece_ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string"}


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """One list of int a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


def encode(docs: DataFrame, model: str | None = None, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Adds to each row the pieces of its whole text.

    piece_ids; starts and ends, the span of bytes of each piece in the UTF-8 text as it
    came (the prefix and characters that normalising adds have an empty span; of the byte
    pieces of a character the last one has its span, the others are empty before it);
    decoded, the text that the ids give. ``keep``: the columns that pass through, all by
    default; columns with the new names are replaced. Null and empty texts have no
    pieces; very long texts are encoded whole; no row is dropped or moved, repeated rows
    are encoded each; an empty table gives an empty one.
    """
    key, content = read_model(model)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in NEW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import docquery.llm.pieces as own

        coder = own.encoder(key, shared.value)
        for b in batches:
            # a few hundred texts at a time: memory follows them, not the batch
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = coder.batch([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                new = [own.lists([g[k] for g in got]) for k in range(3)]
                new.append(pa.array([coder.decode(g[0].tolist()) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*places, *own.NEW])

    # by place, as names may hold any character
    places = [f"c{k}" for k in range(len(kept))]
    schema = [f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(places, kept, strict=True)] + [f"{n} {k}" for n, k in NEW.items()]
    given = docs.select(*[docs[f"`{c}`"].alias(p) for p, c in zip(places, kept, strict=True)], docs[f"`{text}`"].cast("string").alias("__text"))
    return given.mapInArrow(run, ", ".join(schema)).toDF(*kept, *NEW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces and of the text decoded from them; covered_bytes: from the first piece's span to the last one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    covered = F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("starts", F.lit(1)), F.lit(0))
    return encode(docs, keep=["doc_id"]).select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.cast("long").alias("covered_bytes"),
    )
