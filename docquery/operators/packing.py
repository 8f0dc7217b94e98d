"""Blocks and sentences to token-bounded chunks, with any token counter.

Texts become pieces, a row each, that are counted a batch at a time; pieces are sorted
by document and place, and a fold streams over them with one open chunk in memory. A
document is never one value, however many blocks and sentences it has; a document is
sequential by nature, so its pieces pass through one task.

The rules are those of ``docquery.operators.chunking``, whose column functions do the
same within a row and with counters that are column functions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.config import DEFAULTS
from docquery.functions.loaded import Loaded

#: A token counter takes texts and gives the tokens of each.
Counter = Callable[[list[str]], list[int]]
_END = re.compile(r"(?<=[.!?])\s+", re.ASCII)
_WHITE = " \t\n\x0b\x0c\r"
_ROWS = 1000
#: Pieces that are counted ahead at most.
_AHEAD = 32


def by_characters(texts: list[str]) -> list[int]:
    """Characters div 4."""
    return [len(t) // 4 for t in texts]


def by_pandas(function) -> Counter:
    """A counter from a function of a Series of texts, or from a pandas UDF of such a function."""
    own = getattr(function, "func", function)
    return lambda texts: own(pd.Series(texts, dtype=object)).tolist()


def _counter(counter: Counter | Loaded) -> Callable[[], Counter]:
    return counter.get if isinstance(counter, Loaded) else lambda: counter


def _overlap(text: str, most: int, count: Counter) -> str:
    """The longest run of whole sentences at the end that has ``most`` tokens at most."""
    kept, left = "", _END.split(text)[::-1] if text else []
    for at in range(0, len(left), 4):
        longer = [*accumulate(left[at : at + 4], lambda a, s: f"{s} {a}", initial=kept)][1:]
        for t, n in zip(longer, count(longer), strict=True):
            if n > most:
                return kept
            kept = t
    return kept


def _by_words(text: str, size: int, count: Counter) -> Iterator[str]:
    """A sentence that is too long: a part is closed before the word that would fill it."""
    words = deque(w for w in re.split(r"\s+", text, flags=re.ASCII) if w)
    open_text = ""
    while words:
        some = [words[k] for k in range(min(_AHEAD, len(words)))]
        longer = [*accumulate(some, lambda a, w: f"{a} {w}" if a else w, initial=open_text)][1:]
        for n, t, w in zip(count(longer), longer, some, strict=True):
            words.popleft()
            if n >= size:
                if open_text:
                    yield open_text
                open_text = w
                break
            open_text = t
    if open_text:
        yield open_text


def _by_sentences(pieces: Iterator[tuple[str, int]], size: int, overlap: int, count: Counter) -> Iterator[str]:
    """Chunks of sentences (text, tokens); those that are too long are packed by words."""
    cur, ahead, counts = "", deque(), deque()
    while True:
        if not counts:
            total = sum(n for _, n in ahead)
            while len(ahead) < _AHEAD and (not ahead or total < size) and (piece := next(pieces, None)) is not None:
                ahead.append(piece)
                total += piece[1]
            if not ahead:
                break
            counts.extend(count([*accumulate((s for s, _ in ahead), lambda a, s: f"{a}{s} ", initial=cur)][1:]))
        (s, n), longer = ahead.popleft(), counts.popleft()
        if longer <= size:
            cur = f"{cur}{s} "
            continue
        counts.clear()
        if cur:
            yield cur.strip(_WHITE)
        if n > size:
            yield from _by_words(s, size, count)
            cur = ""
        else:
            cur = f"{_overlap(cur, overlap, count)}{s} "
    if cur.strip(_WHITE):
        yield cur.strip(_WHITE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)

    for r in rows:
        kept.append(r)
        if len(kept) == _ROWS:
            yield made()
            kept = []
    if kept:
        yield made()


_PIECE = ["document_id", "block_idx", "piece", "type", "text", "page_number", "section", "split", "tokens"]


def pieces(blocks: DataFrame, size: int, counter: Counter | Loaded = by_characters) -> DataFrame:
    """Blocks (document_id, block_idx, type, text, page_number, section) as counted rows: a block whole, or the sentences of one that has over ``size`` tokens and is no title or heading."""
    load = _counter(counter)
    given = blocks.select("document_id", F.col("block_idx").cast("long").alias("block_idx"), "type", F.coalesce("text", F.lit("")).alias("text"), F.col("page_number").cast("int").alias("page_number"), F.col("section").cast("string").alias("section"))
    kind = given.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load()
        for whole in batches:
            doc = whole.schema.field(0).type

            def cut(whole: pa.RecordBatch = whole) -> Iterator[tuple]:
                for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                    rows = [*_rows([b])]
                    for (d, i, t, text, page, section), n in zip(rows, count([r[3] for r in rows]), strict=True):
                        if n <= size or t in ("title", "heading"):
                            yield d, i, 0, t, text, page, section, False, n
                            continue
                        found = _END.split(text)
                        for at in range(0, len(found), _ROWS):
                            part = found[at : at + _ROWS]
                            for k, (s, m) in enumerate(zip(part, count(part), strict=True)):
                                yield d, i, at + k, t, s, page, section, True, m

            yield from _batches(cut(), [doc, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64()], _PIECE)

    return given.mapInArrow(run, f"document_id {kind}, block_idx long, piece long, type string, text string, page_number int, section string, split boolean, tokens long")


class _Open:
    """The open chunk of a document."""

    def __init__(self):
        self.text, self.pages, self.sections = "", [], []


def _fold(rows: Iterator[tuple], size: int, overlap: int, least: int, leak: bool, count: Counter) -> Iterator[tuple]:
    """Final (document, text, pages, sections) of sorted pieces."""
    one = lambda text: count([text])[0]
    doc, state, n_open = object(), _Open(), None
    rows = iter(rows)
    row = next(rows, None)

    def enough() -> bool:
        return state.text != "" and one(state.text) >= least

    def closed(strip: bool = True) -> tuple:
        return doc, state.text.strip(_WHITE) if strip else state.text, state.pages, state.sections

    while row is not None:
        if doc != row[0]:
            if n_open is not None and enough():
                yield closed()
            doc, state, n_open = row[0], _Open(), 0
        _, place, _, kind, text, page_number, section, split, n = row
        page, sections = [page_number] if page_number else [], [section] if section else []
        if split:  # a block that is too long
            if enough():
                yield closed()

            def own(first: tuple = row) -> Iterator[tuple[str, int]]:
                nonlocal row
                row = first
                while row is not None and row[7] and (row[0], row[1], row[3]) == (first[0], first[1], first[3]) and (row is first or row[2] > 0):
                    yield row[4], row[8]
                    row = next(rows, None)

            for part in _by_sentences(own(), size, overlap, count):
                yield doc, part, page, sections
            state = _Open()
            continue
        row = next(rows, None)
        if kind == "title":
            yield doc, text, [page_number], []
        elif kind == "heading":
            if enough():
                yield closed(strip=False)
                state.pages, state.sections = page, sections
            else:
                state.pages, state.sections = (state.pages + page, state.sections + sections) if leak else (page, sections)
            state.text = f"{text}\n\n"
        elif one(f"{state.text}{text}\n\n") <= size:
            state.text = f"{state.text}{text}\n\n"
            state.pages, state.sections = [*dict.fromkeys(state.pages + page)], [*dict.fromkeys(state.sections + sections)]
        else:
            if enough():
                yield closed()
            state.text = f"{_overlap(state.text, overlap, count)}{text}\n\n"
            state.pages, state.sections = page, sections
    if n_open is not None and enough():
        yield closed()


def _numbered(rows: Iterator[tuple], count: Counter) -> Iterator[tuple]:
    """Chunks with their number in the document and their tokens, counted some hundred at a time."""
    doc, number = object(), 0
    kept: list[tuple] = []

    def out() -> Iterator[tuple]:
        for (d, i, text, pages, sections), n in zip(kept, count([k[2] for k in kept]), strict=True):
            yield d, i, text, pages, sections, n

    for d, text, pages, sections in rows:
        doc, number = d, number + 1 if d == doc else 0
        kept.append((d, number, text, pages, sections))
        if len(kept) == 256:
            yield from out()
            kept = []
    if kept:
        yield from out()


def pack_blocks(blocks: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.chunk_minimum, *, leak: bool = False, counter: Counter | Loaded = by_characters) -> DataFrame:
    """Blocks (document_id, block_idx, type, text, page_number, section) to chunks (document_id, chunk_index, content, page_numbers, sections, token_count); the rules are those of ``chunking.pack_blocks``.

    ``counter``: a function of a list of texts, ``by_pandas`` of one of a Series, or
    ``Loaded`` with what makes one, which runs once a worker. Chunks are bounded by its
    counts of their whole texts, not by sums. Null text is empty; equal block numbers
    of a document go by type and text; null documents are one document; a document
    without blocks has no chunks.
    """
    load = _counter(counter)
    rows = pieces(blocks, size, counter).repartition("document_id").sortWithinPartitions("document_id", "block_idx", "type", "page_number", "section", "piece", "text")
    kind = rows.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, batches = load(), iter(batches)
        first = next(batches, None)
        if first is None:
            return

        def all_rows() -> Iterator[tuple]:
            yield from _rows([first])
            yield from _rows(batches)

        kinds = [first.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32()]
        yield from _batches(_numbered(_fold(all_rows(), size, overlap, least, leak, count), count), kinds, ["document_id", "chunk_index", "content", "page_numbers", "sections", "token_count"])

    return rows.mapInArrow(run, f"document_id {kind}, chunk_index int, content string, page_numbers array<int>, sections array<string>, token_count int")


def pack_sentences(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, *, counter: Counter | Loaded = by_characters) -> DataFrame:
    """Texts (document_id, text) to (document_id, chunk_index, content) by sentences with overlap, whatever their length; null and empty texts have no chunks."""
    load = _counter(counter)
    given = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = given.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load()

        def counted(text: str) -> Iterator[tuple[str, int]]:
            found = _END.split(text)
            for at in range(0, len(found), _ROWS):
                yield from zip(found[at : at + _ROWS], count(found[at : at + _ROWS]), strict=True)

        for b in batches:
            chunks = ((d, k, c) for d, text in _rows([b]) for k, c in enumerate(_by_sentences(counted(text), size, overlap, count)))
            yield from _batches(chunks, [b.schema.field(0).type, pa.int32(), pa.string()], ["document_id", "chunk_index", "content"])

    return given.mapInArrow(run, f"document_id {kind}, chunk_index int, content string")
