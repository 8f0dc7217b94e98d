import random
import zlib

import pytest
from docquery.llm import toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = toxicity.score(docs, model).filter(toxicity.held_out(F.col("doc_id"))).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    # a few labels are wrong: some toxic ones mark texts without any toxic word
    assert sum(s >= 0.7 for s in toxic) >= 0.9 * len(toxic)
    assert sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)
    assert all(0 <= s <= 1 for s in toxic + clean) and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_a_small_sample_teaches_enough(spark):
    small = SF.replace("sf0.1", "sf0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    # some of the toxic labels mark texts without any toxic word
    assert sum(s >= 0.7 for s in toxic) >= 0.75 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)


def test_more_hits_never_lower_a_score(spark, model):
    assert min(model.coefficients[1:]) >= 0
    hits = sorted(w for w in model.weights if not w.startswith("^"))
    rows = [(k, "the tion of and " * 20 + " ".join(hits[:k])) for k in range(min(25, len(hits)))]
    got = [r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert all(a <= b for a, b in zip(got, got[1:], strict=False)) and got[-1] > 0.9


def test_the_query_against_a_plain_version(spark, sf_dir):
    """Scores of the query, computed anew from its own model for each text in plain Python."""
    docs, labels = toxicity.documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    import numpy as np

    cost = model.cost.astype(np.float32).tolist()
    texts = {r.doc_id: r.text for r in docs.collect()}
    reader = toxicity.Reader(cost, model.weights)
    for r in toxicity.query(spark, sf_dir).collect():
        words = reader.words(texts[r.doc_id] or "")
        top = max((model.weights.get(k, 0.0) for w in words for k in toxicity.keys(w)), default=0.0)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
        none = 1 / (1 + 2.718281828459045 ** -model.coefficients[0])
        assert (r.score > none + 1e-9) == (top > 0 and max(model.coefficients[1:]) > 0), r.doc_id


def test_restored_texts(spark, model):
    base = "the tion of and thing onan er in " * 8
    rng = random.Random(5)
    written = ["1d10t", "l0s3r", "m.o.r.o.n", "i d i o t", "stuuuupid", "idi0t!!", "tr@sh", "p@thetic", "d1sgust1ng", "id!ot", "s.c.u.m", "losssser"]
    rows = []
    for i, w in enumerate(written):
        words = base.split()
        for x in rng.sample(written, 3) + [w]:
            words.insert(rng.randrange(len(words)), x)
        rows.append((i, " ".join(words)))
    clean = [(100, base), (101, ""), (102, None), (103, "the 1st of 2nd in 2024, a.b.c and x y z q"), (104, "a" * 200_000), (105, "4eae" * 10)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows + clean, "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.7 for i, _ in rows), got
    assert all(got[i] < 0.7 for i, _ in clean), got
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string, score int"), model).columns == ["doc_id", "score"]


def test_viterbi_finds_the_cheapest_reading():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    cost = rng.uniform(0.5, 5, (toxicity.A, toxicity.A, toxicity.A)).tolist()

    def price(text_of):
        a = b = 0
        total, out = 0.0, ""
        for kind, letter, extra in text_of:
            total += extra
            if kind == "letter":
                x = toxicity._INDEX[letter]
                total += cost[a][b][x]
                a, b, out = b, x, out + letter
            elif kind == "repeat" and (not b or toxicity._INDEX[letter] != b):
                return None
            elif kind == "seam":
                out += toxicity.SEAM
            elif kind == "boundary" and b:
                total += cost[a][b][0]
                a, b, out = b, 0, out + " "
        return total + (cost[a][b][0] if b else 0.0), out.strip(" " + toxicity.SEAM)

    for token in ("1oo", "a1-b", "$$a", "0l1", "a b c", "a 1 a", "a\nb", "ab-.c"):
        options = []
        for c in token:
            o = [(c, 0.0)] if c in toxicity._INDEX else [(x, toxicity.IMITATED) for x in toxicity.IMITATES.get(c, "")]
            own = [(k, x, e + p) for x, e in o for k, p in (("letter", 0.0), ("repeat", toxicity.REPEATED))]
            if c == " ":
                own += [("seam", None, toxicity.JOINED), ("boundary", None, 0.0)]
            elif c == "\n":
                own += [("seam", None, toxicity.LOST), ("boundary", None, 0.0)]
            elif not o:
                own += [("seam", None, toxicity.NOTHING), ("boundary", None, toxicity.BROKEN)]
            elif c not in toxicity._INDEX:
                own.append(("lost", None, toxicity.LOST))
            options.append(own)
        best = min(p for p in (price(way) for way in itertools.product(*options)) if p is not None)
        assert toxicity.decode(token, cost) == best[1]


def test_any_length_and_spacing(spark, model):
    base = "the tion of and thing onan er in " * 8
    written = [
        "1d10t" + "!" * 60,
        "s" + "t" * 70 + "upid",
        "i   d   i   o   t",
        "i d ! 0 t",
        "id io t",
        "y o u a r e a n i d i o t s o g o",
        "s t u p i d a n d u g l y l o s e r",
        " ".join("nothinghereatallbutsomanylettersthatthewordcomesverylate" + "scum" + "andgoes"),
        "x" * 300 + "-1d10t-" + "y" * 300,
        "word " * 60_000 + "1d10t and s t u p i d",
        "los er and stu pid",
        *(("i" + " " * k + "d" + " " * k + "i" + " " * k + "o" + " " * k + "t") for k in (2, 4, 11, 20)),
        "idi ots",
        "lo sers",
        "mor ons here",
        "pathe tic",
    ]
    rows = [(i, f"{base} {w} {base}") for i, w in enumerate(written)]
    rows += [*rows[:2], (None, rows[0][1])]  # repeated rows and ties
    scored = [(r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert len(scored) == len(rows) and all(s >= 0.7 for _, s in scored), scored
    assert len({s for d, s in scored if d in (0, None)}) == 1
    clean = ["is it in an of to be", "A B C D E F G", "0123456789abcdef" * 3000, "1 2 3 4 5 6", "a.b.c.d.e.f", ("q w e r t z " * 2000)]
    assert all(r.score < 0.7 for r in toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(clean)], "doc_id long, text string"), model).collect())


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some words"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for d, y in ((docs, labels), (docs.limit(0), labels.limit(0)), (docs.limit(0), labels)):
        model = toxicity.train(d, y)
        assert all(r.score < 0.7 for r in toxicity.score(docs, model).collect())
