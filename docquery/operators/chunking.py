"""Documents to blocks and blocks to token-bounded chunks.

Packing depends on order, so a document is one fold over its blocks or sentences; documents are
independent of each other. Tokens are counted as characters div 4 unless a column function is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.config import DEFAULTS
from docquery.functions.text import stripped

#: Fixed value: a sentence ends after one of these, before white space.
SENTENCE_END = r"(?<=[.!?])\s+"
Counter = Callable[[Column], Column]


def count_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def paragraphs(docs: DataFrame, document_id: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, block_idx, type, text): parts between blank lines, stripped, empty ones left out; a part whose first line starts with # is a heading."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")
    out = docs.select(F.col(document_id).alias("document_id"), F.posexplode(parts).alias("block_idx", "text"))
    return out.select("document_id", "block_idx", F.when(F.col("text").startswith("#"), "heading").otherwise("paragraph").alias("type"), "text")


def page_blocks(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page_number, text) to blocks: the first line of page 1 with text is a title, before the page's own text, without white space at its ends."""
    first = F.get(F.filter(F.transform(F.split("text", "\n"), stripped), lambda x: x != ""), F.lit(0))
    title = pages.filter("page_number = 1").withColumn("first", first).filter("first is not null").select("document_id", "page_number", F.lit(0).alias("place"), F.lit("title").alias("type"), F.concat(F.lit("DOCUMENT TITLE: "), "first").alias("text"))
    body = pages.filter(stripped(F.col("text")) != "").select("document_id", "page_number", F.lit(1).alias("place"), F.lit("text").alias("type"), stripped(F.col("text")).alias("text"))
    order = Window.partitionBy("document_id").orderBy("page_number", "place")
    return title.unionByName(body).withColumn("block_idx", F.row_number().over(order) - 1).drop("place")


def with_sections(blocks: DataFrame) -> DataFrame:
    """Adds section: the last heading up to the block, '' before the first."""
    so_far = Window.partitionBy("document_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last_value(F.when(F.col("type") == "heading", F.col("text")), F.lit(True)).over(so_far), F.lit("")))


def document_stats(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks, headings, paragraphs, pages, characters and tables (document_id: a row each) of each document."""
    kind = lambda t: F.count_if(F.col("type") == t)
    own = blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), kind("heading").alias("headings"), kind("paragraph").alias("paragraph_count"), F.max("page_number").alias("page_count"), F.sum(F.length("text")).alias("character_count"))
    n = tables.groupBy("document_id").agg(F.count("*").alias("table_count"))
    return own.join(n, "document_id", "left").withColumn("table_count", F.coalesce("table_count", F.lit(0)))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def overlap_text(text: Column, overlap: int = DEFAULTS.chunk_overlap, tokens: Counter = count_tokens) -> Column:
    """The longest run of whole sentences at the end that has ``overlap`` tokens at most."""
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.concat(s, F.lit(" "), acc["kept"])
        fits = ~acc["full"] & (tokens(longer) <= overlap)
        return F.struct(F.when(fits, longer).otherwise(acc["kept"]).alias("kept"), (~fits).alias("full"))

    return F.when(text == "", F.lit("")).otherwise(F.aggregate(F.reverse(sentences(text)), start, step, lambda acc: acc["kept"]))


def _appended(out: Column, text: Column, when: Column) -> Column:
    return F.when(when, F.concat(out, F.array(text))).otherwise(out)


_NONE = "cast(array() as array<string>)"


def word_chunks(text: Column, size: int = DEFAULTS.chunk_size, tokens: Counter = count_tokens) -> Column:
    """A sentence that is too long, packed by words: a part is closed before the word that would fill it."""
    start = F.struct(F.lit("").alias("cur"), F.expr(_NONE).alias("out"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["cur"] == "", w).otherwise(F.concat(acc["cur"], F.lit(" "), w))
        full = tokens(longer) >= size
        return F.struct(F.when(full, w).otherwise(longer).alias("cur"), _appended(acc["out"], acc["cur"], full & (acc["cur"] != "")).alias("out"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda acc: _appended(acc["out"], acc["cur"], acc["cur"] != ""))


def sentence_chunks(text: Column, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, tokens: Counter = count_tokens) -> Column:
    """A block that is too long, packed by sentences with overlap; sentences that are too long are packed by words: array<string>."""
    start = F.struct(F.lit("").alias("cur"), F.expr(_NONE).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["cur"], s, F.lit(" "))
        closed = _appended(acc["out"], stripped(acc["cur"]), acc["cur"] != "")
        keep = F.struct(longer.alias("cur"), acc["out"].alias("out"))
        by_words = F.struct(F.lit("").alias("cur"), F.concat(closed, word_chunks(s, size, tokens)).alias("out"))
        anew = F.struct(F.concat(overlap_text(acc["cur"], overlap, tokens), s, F.lit(" ")).alias("cur"), closed.alias("out"))
        return F.when(tokens(longer) <= size, keep).when(tokens(s) > size, by_words).otherwise(anew)

    return F.aggregate(sentences(text), start, step, lambda acc: _appended(acc["out"], stripped(acc["cur"]), stripped(acc["cur"]) != ""))


def pack_blocks(blocks: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.chunk_minimum, *, leak: bool = False, tokens: Counter = count_tokens) -> DataFrame:
    """Blocks (document_id, block_idx, type, text, page_number, section) to chunks (document_id, chunk_index, content, page_numbers, sections, token_count).

    A title is a chunk of its own. A heading closes an open chunk of ``least`` tokens
    (not stripped) and starts the next; a shorter open text is lost, and with ``leak``
    its pages and sections stay with the next chunk. A block that does not fit closes
    the open chunk and starts the next after an overlap, whatever the sum; a block
    that is too long is split by sentences, and by words below that, which have no
    page. A rest under ``least`` tokens is dropped.
    """
    rows = F.array_sort(F.collect_list(F.struct("block_idx", "type", "text", "page_number", "section")))
    docs = blocks.groupBy("document_id").agg(rows.alias("blocks"))
    piece = "array<struct<t:string,pages:array<int>,sections:array<string>,split:boolean>>"
    no_pages, no_sections = F.expr("cast(array() as array<int>)"), F.expr(_NONE)
    start = F.struct(F.lit("").alias("cur"), no_pages.alias("pages"), no_sections.alias("sections"), F.expr(f"cast(array() as {piece})").alias("out"))
    made = lambda t, p, s, split=False: F.array(F.struct(t.alias("t"), p.alias("pages"), s.alias("sections"), F.lit(split).alias("split")))
    state = lambda cur, pages, sections, out: F.struct(cur.alias("cur"), pages.alias("pages"), sections.alias("sections"), out.alias("out"))

    def step(acc: Column, b: Column) -> Column:
        page = F.when(b["page_number"].isNull() | (b["page_number"] == 0), no_pages).otherwise(F.array(b["page_number"]))
        section = F.when(F.coalesce(b["section"], F.lit("")) == "", no_sections).otherwise(F.array(b["section"]))
        enough = (acc["cur"] != "") & (tokens(acc["cur"]) >= least)
        title = state(acc["cur"], acc["pages"], acc["sections"], F.concat(acc["out"], made(b["text"], F.array(b["page_number"]), no_sections)))
        kept_p, kept_s = (acc["pages"], acc["sections"]) if leak else (no_pages, no_sections)
        heading = state(F.concat(b["text"], F.lit("\n\n")), F.when(enough, page).otherwise(F.concat(kept_p, page)), F.when(enough, section).otherwise(F.concat(kept_s, section)), F.when(enough, F.concat(acc["out"], made(acc["cur"], acc["pages"], acc["sections"]))).otherwise(acc["out"]))
        longer = F.concat(acc["cur"], b["text"], F.lit("\n\n"))
        fits = state(longer, F.array_union(acc["pages"], page), F.array_union(acc["sections"], section), acc["out"])
        closed = F.when(enough, F.concat(acc["out"], made(stripped(acc["cur"]), acc["pages"], acc["sections"]))).otherwise(acc["out"])
        large = state(F.lit(""), no_pages, no_sections, F.concat(closed, made(b["text"], page, section, True)))
        anew = state(F.concat(overlap_text(acc["cur"], overlap, tokens), b["text"], F.lit("\n\n")), page, section, closed)
        return F.when(b["type"] == "title", title).when(b["type"] == "heading", heading).when(tokens(longer) <= size, fits).when(tokens(b["text"]) > size, large).otherwise(anew)

    def finish(acc: Column) -> Column:
        return F.when((acc["cur"] != "") & (tokens(acc["cur"]) >= least), F.concat(acc["out"], made(stripped(acc["cur"]), acc["pages"], acc["sections"]))).otherwise(acc["out"])

    folded = docs.select("document_id", F.posexplode(F.aggregate("blocks", start, step, finish)).alias("place", "c"))
    parts = F.when(F.col("c.split"), sentence_chunks(F.col("c.t"), size, overlap, tokens)).otherwise(F.array("c.t"))
    split = folded.select("document_id", "place", F.posexplode(parts).alias("part", "content"), "c.pages", "c.sections")
    by = Window.partitionBy("document_id").orderBy("place", "part")
    return split.select("document_id", (F.row_number().over(by) - 1).alias("chunk_index"), "content", F.col("pages").alias("page_numbers"), "sections", tokens(F.col("content")).alias("token_count"))


def chunk_records(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with their document's metadata and a chunk id; every metadata column is carried, for text chunks too."""
    meta = files.drop("text")
    return chunks.join(meta, "document_id", "left").withColumns({"chunk_id": F.concat_ws("_", "document_id", F.col("chunk_index").cast("string")), "chunk_type": F.lit("text")})


def combined(text_chunks: DataFrame, table_chunks: DataFrame) -> DataFrame:
    """Text and table chunks in one table."""
    return text_chunks.unionByName(table_chunks, allowMissingColumns=True)


def ingest_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each document by type, and success, or a warning where there are none."""
    n = chunks.groupBy("document_id").agg(F.count_if(F.col("chunk_type") == "text").alias("text_chunks"), F.count_if(F.col("chunk_type") != "text").alias("table_chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.select("document_id").join(n, "document_id", "left").select("document_id", zero("text_chunks"), zero("table_chunks"), F.when(F.coalesce(F.col("text_chunks") + F.col("table_chunks"), F.lit(0)) > 0, "success").otherwise("warning").alias("status"))
