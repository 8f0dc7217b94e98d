import re

from docquery.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, places = {}, []
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines, dup, earlier = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in earlier
            earlier.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = ["", None, "  \n ", "a b c d e f g h a b c d e f g h", "x " * 40, "\n".join(["same line here."] * 30), "one\x0btwo\x0cthree\x1dfour", "é" * 10 + " # |"]
    more = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").unionByName(more).collect()}
    got = {r.doc_id: r for r in quality.judged(docs.select("doc_id", "text").unionByName(more)).collect()}
    assert len(got) == len(rows)
    for d, text in rows.items():
        r = got[d]
        n, chars, symbols, dup, repeated = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated), d
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)


def test_lines_and_verdicts(spark):
    good = "This is a sentence of enough words to be kept, and it ends as sentences do."
    bad = "Home | News | Sport | Weather | Shop"
    other = "Here stands quite another sentence, of different words, which nobody has read before now."
    rows = [(1, f"{good}\n{other}\n{bad}"), (2, "\n".join([good] + [f"{bad} | {i}" for i in range(9)])), (3, None), (4, f"{other}\n{good}\nAll rights reserved.")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, kept string, n_chars long")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got[1].kept and bad not in got[1].clean_text and not got[2].kept and not got[3].kept
    kept = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert sorted(kept) == [1, 4] and kept[1].kept == "x" and kept[1].n_chars == len(kept[1].text) and "All rights" not in kept[4].text
    assert quality.clean(docs.limit(0)).count() == 0


def test_labelled_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert judged.filter("quality = 1 and not kept and not base_failed").count() == 0
    assert judged.filter("quality = 0 and kept").count() <= 0.05 * judged.filter("quality = 0").count()
