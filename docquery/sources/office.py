"""Files to elements in order: paragraphs, headings and tables of text, Markdown and DOCX files.

A file that can't be parsed is one element with its error; the others go on.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.config import DEFAULTS

SCHEMA = "document_id string, filename string, place int, type string, text string, rows array<array<string>>, error string"
_KINDS = pa.schema([("document_id", pa.string()), ("filename", pa.string()), ("place", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("error", pa.string())])
#: Fixed value: the name space of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Elements that are written out together.
_ROWS = 1000


def text_elements(content: bytes) -> Iterator[tuple]:
    """Paragraphs between blank lines; one whose first line starts with # is a heading. Bytes that are no UTF-8 are left out."""
    for part in content.decode("utf-8", "ignore").split("\n\n"):
        if part := part.strip():
            yield ("heading" if part.startswith("#") else "paragraph"), part, None


def _said(node: ElementTree.Element) -> str:
    """The text of a paragraph: runs in order, tabs and breaks as characters."""
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx_elements(content: bytes) -> Iterator[tuple]:
    """The body of a DOCX file in order. A paragraph is a heading where its style's name says so; a table's first row is its header."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = "" if name is None else name.get(f"{_W}val", "")
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            if text := _said(node).strip():
                style = node.find(f"{_W}pPr/{_W}pStyle")
                name = "" if style is None else styles.get(style.get(f"{_W}val"), "")
                yield ("heading" if "Heading" in name or re.fullmatch("heading [1-9]", name) else "paragraph"), text, None
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(_said(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            if rows:
                yield "table", "", rows


PARSERS = {".txt": text_elements, ".md": text_elements, ".docx": docx_elements}


def elements(files: DataFrame, most: int = DEFAULTS.max_file_bytes) -> DataFrame:
    """Files (path, content) to their elements (document_id: md5 of the path, filename, place, type, text, rows, error).

    ``type`` is heading, paragraph or table (``rows``: the header row first). A file
    without elements has one row of type ``empty``; one of a format without a parser,
    over ``most`` bytes, without content or that its parser doesn't take has one row
    of type ``failed`` with the error. A file is one value, as its source gives it.
    """
    given = files.select(F.md5("path"), F.regexp_extract("path", "([^/]*)$", 1), "content")

    def parsed(document: str, name: str, content: bytes | None) -> Iterator[tuple]:
        kind = f".{name.rpartition('.')[2].lower()}" if "." in name else ""
        try:
            if kind not in PARSERS:
                raise ValueError(f"Unsupported file format: {kind}")
            if content is None or len(content) > most:
                raise ValueError("No content" if content is None else f"Over {most} bytes")
            found = [*PARSERS[kind](content)] or [("empty", "", None)]
        except Exception as e:  # one file does not end the run
            yield document, name, 0, "failed", "", None, f"{type(e).__name__}: {e}"
            return
        for k, (t, text, rows) in enumerate(found):
            yield document, name, k, t, text, rows, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for b in batches:
            for k in range(b.num_rows):
                for row in parsed(*(c[k].as_py() for c in b.columns)):
                    kept.append(row)
                    if len(kept) == _ROWS:
                        yield pa.record_batch([list(c) for c in zip(*kept, strict=True)], schema=_KINDS)
                        kept = []
        if kept:
            yield pa.record_batch([list(c) for c in zip(*kept, strict=True)], schema=_KINDS)

    return given.mapInArrow(run, SCHEMA)
