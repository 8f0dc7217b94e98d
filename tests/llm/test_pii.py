import hashlib
import random
import re

from docquery.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    return sorted(found)


def written(found):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)


def noise(rng):
    parts = ["a@b.co", "x", "@", ".", "-", "+", "1", "4111111111111111", "4111 1111-1111 1111", "+1 (858) 555-7280", "10.0.0.1", "256.1.1.1", "001.2.3.4.5.6.7.8", " ", "\n", "_d@e.f", "é", "😀", "%", "(", ")", "00", "a.b-c@d-e.f.g", "79927398713", "9", "at", "[at]", "dot"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))


def test_base_spans(spark, sf_dir):
    rng = random.Random(1)
    texts = [None, "", "1" * 20000, "a" * 20000 + "@b.c", "1 " * 5000, "a@" * 3000, "+" * 500 + "1 2", "1." * 4000, *(noise(rng) for _ in range(600))]
    docs = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows)
    for d, text in rows.items():
        want, r = brute(text), got[d]
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), (d, text and text[:200], r.spans[:200], written(want)[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)]
        assert not want or set(written(want).split(",")) <= set(r.spans.split(","))


def test_added_spans_and_redaction(spark):
    sf = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars")
    own = [(-1, "Please mail jo.doe (at) example (dot) com or call 303-555-0142, thanks.", 1), (-2, "Card 4111.1111.1111.1111 and mail a@b.co é 10.1.2.3", 1), (-3, None, None), (-4, "On 2024-01-02 we sold 1234567 of 89, version 1.2.3.", 1)]
    docs = base.unionByName(spark.createDataFrame(own, "doc_id long, text string, n_chars long")).withColumnRenamed("n_chars", "spans").withColumnRenamed("spans", "n_chars")
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[-2].text.endswith("mail [EMAIL] é [IP]") and clean[-2].n_chars == len(clean[-2].text)
    assert clean[-3].text is None and clean[-4].text == own[3][1]
    assert not any(brute(r.text) and re.search(PLAIN["email"], r.text) for r in clean.values())
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[-4].spans == "" and sum(r.n_added for r in found.values() if r.doc_id >= 0) <= 0.01 * len(found)
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).columns == docs.columns


def test_many_matches_take_time_in_proportion(spark):
    import time

    def took(n):
        text = "".join(f"a{i}@b.co, 10.0.0.{i % 300} and (404) 555-{i % 10000:04d}\n" for i in range(n))
        began = time.time()
        row = pii.find(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).orderBy("doc_id").head()
        want = brute(text)
        assert row.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        return time.time() - began

    took(500)  # compiled first
    few, many = took(2000), took(20_000)
    assert many < 25 * few


def test_added_spans_follow_the_context(spark):
    """Telephone numbers come after a cue and other numbers do not: a check of form alone cannot tell them, the trees can."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    texts = []
    for _ in range(400):
        texts += [f"please call +1 {number(3)}-{number(3)}-{number(4)} soon", f"order {number(16)}0 was sent"]
    own = [(-1, "please call 303-555-0142 soon", True), (-2, "order 303-555-0142 was sent", False), (-3, "see call 404-555-0199 and call 404-555-0198", True)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t, _ in own], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs.unionByName(docs.filter("doc_id = -1"))).collect()}
    assert [got[i].n_added > 0 for i, _, _ in own] == [w for _, _, w in own]
    assert got[-1].spans == "phone:12:24" and got[-3].n_added == 2


def test_redaction_of_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "mail a@b.co and +1 (858) 555-7280 x", "s1", "c1", 5, 7), (1, "mail a@b.co and +1 (858) 555-7280 x", "s1", "c1", 5, 7), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, __candidates string, n_chars int, end int")
    got = [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()]
    clean = "mail [EMAIL] and [PHONE] x"
    assert got == [(1, clean, "s1", "c1", len(clean), 7)] * 2 + [(2, None, None, None, None, None)]
