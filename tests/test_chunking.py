"""Folds against plain restatements of the rules, and one case for each rule that loses or repeats text."""

import re

from docquery.operators import chunking
from docquery.plans import text_plans
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
n = lambda t: len(t) // 4


def words(text, size):
    out, cur = [], []
    for w in text.split():
        if n(" ".join([*cur, w])) >= size:
            out += [" ".join(cur)] if cur else []
            cur = []
        cur.append(w)
    return out + ([" ".join(cur)] if cur else [])


def overlap(text, most):
    kept = ""
    for s in reversed(re.split(r"(?<=[.!?])\s+", text)) if text else ():
        if n(s + " " + kept) > most:
            break
        kept = s + " " + kept
    return kept


def sentences(text, size, most):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if n(cur + s + " ") <= size:
            cur += s + " "
            continue
        out += [cur.strip()] if cur else []
        if n(s) > size:
            out, cur = out + words(s, size), ""
        else:
            cur = overlap(cur, most) + s + " "
    return out + ([cur.strip()] if cur.strip() else [])


def packed(blocks, size, most, least):
    out, cur, pages = [], "", []
    for kind, text, page in blocks:
        own = [page] if page else []
        if kind == "title":
            out.append((text, [page]))
        elif kind == "heading":
            if cur and n(cur) >= least:
                out.append((cur, pages))
            cur, pages = text + "\n\n", own
        elif n(cur + text + "\n\n") <= size:
            cur, pages = cur + text + "\n\n", pages + [p for p in own if p not in pages]
        else:
            if cur and n(cur) >= least:
                out.append((cur.strip(), pages))
            if n(text) > size:
                out += [(t, own) for t in sentences(text, size, most)]
                cur, pages = "", []
            else:
                cur, pages = overlap(cur, most) + text + "\n\n", own
    return out + ([(cur.strip(), pages)] if cur and n(cur) >= least else [])


def test_sentence_chunks(spark):
    rows = {r.document_id: r.text for r in text_plans.fx.files(spark, SF).collect()} | {"a": "w" * 3000, "b": ("wor " * 3000).strip(), "c": "", "d": "Short one. " * 400}
    frame = spark.createDataFrame(list(rows.items()), "id string, text string")
    got = {r.id: r.c for r in frame.select("id", chunking.sentence_chunks(F.col("text"), 120, 25).alias("c")).collect()}
    assert got == {d: sentences(t, 120, 25) for d, t in rows.items()}


def test_pack_blocks(spark):
    blocks = {}
    for r in text_plans.blocks(spark, SF).orderBy("document_id", "block_idx").collect():
        blocks.setdefault(r.document_id, []).append((r.type, r.text, r.page_number))
    got = {}
    for r in text_plans.packed(spark, SF).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append((r.content, list(r.page_numbers)))
    assert got == {d: c for d, c in ((d, packed(b, 120, 25, 30)) for d, b in blocks.items()) if c}


def test_rules(spark):
    long, short = ("x" * 39 + ". ") * 11, "y" * 60 + "."
    cases = {
        "lost": [("paragraph", short, 1), ("heading", "# H", 2), ("paragraph", long, 2)],
        "unstripped": [("paragraph", long, 1), ("heading", "# H", 2)],
        "overlap_only": [("paragraph", short, 1), ("paragraph", "z" * 470, 2)],
        "oversized": [("paragraph", short, 1), ("paragraph", long * 2, 2)],
        "tail": [("paragraph", short, 1)],
        "title": [("paragraph", long, 1), ("title", "T", 1), ("paragraph", short, 1)],
        "wordy": [("paragraph", "w" * 700 + " " + "v " * 300, 3)],
    }
    rows = [(d, i, k, t, p, "") for d, b in cases.items() for i, (k, t, p) in enumerate(b)]
    frame = spark.createDataFrame(rows, "document_id string, block_idx int, type string, text string, page_number int, section string")
    got = {}
    for r in chunking.pack_blocks(frame, 120, 25, 30).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append((r.content, list(r.page_numbers)))
    want = {d: packed(b, 120, 25, 30) for d, b in cases.items()}
    assert got == {d: c for d, c in want.items() if c} and want["tail"] == [] and want["unstripped"][0][0].endswith("\n\n")
    leaked = {r.document_id: list(r.page_numbers) for r in chunking.pack_blocks(frame.filter("document_id = 'lost'"), 150, 25, 30, leak=True).collect()}
    assert leaked == {"lost": [1, 2]}


def plain_sentence_chunks(text, size, overlap):
    """The rules of K-3 to K-5 as loops."""
    import re

    strip = lambda t: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t)
    split = lambda t: re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", t)
    tokens = lambda t: len(t) // 4
    out, cur = [], ""
    for s in split(text):
        if tokens(cur + s + " ") <= size:
            cur += s + " "
            continue
        if cur:
            out.append(strip(cur))
        if tokens(s) > size:
            part = ""
            for w in [w for w in re.split(r"[ \t\n\x0b\f\r]+", s) if w]:
                longer = f"{part} {w}" if part else w
                if tokens(longer) >= size:
                    out += [part] if part else []
                    longer = w
                part = longer
            out += [part] if part else []
            cur = ""
        else:
            kept = ""
            for x in reversed(split(cur)) if cur else ():
                if tokens(f"{x} {kept}") > overlap:
                    break
                kept = f"{x} {kept}"
            cur = kept + s + " "
    return out + ([strip(cur)] if strip(cur) else [])


def test_sentence_chunks_and_their_stream_against_plain_python(spark, sf_dir):
    from docquery.plans import registry

    want = sorted((str(r.doc_id), i, c) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, c in enumerate(plain_sentence_chunks(r.text, 120, 25)))
    for name in ("k3_k5_sentence_chunks", "r1_ingest"):
        assert sorted(tuple(r) for r in registry.queries()[name](spark, sf_dir).select("document_id", "chunk_index", "content").collect()) == want
