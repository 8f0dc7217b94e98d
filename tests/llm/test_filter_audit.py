import itertools
import re
from collections import Counter

import duckdb
from docquery.llm import filter_audit
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "one two three " + " ".join(f"w{k}" for k in range(110))


def brute(rows, labels):
    """The audit by applying the filters in each order to each document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = WORDS.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((lang or "", {x for x in f if f[x]}, *labels.get(i, (0, 0))))
    out, shares = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in itertools.permutations("ABCDE"):
            for s, f in enumerate(order):
                own = [x for x in fails if x[0] == part]
                left = [x for x in own if not x[1] & set(order[:s])]
                gone = [x for x in left if f in x[1]]
                out[part, "".join(order), s + 1] = [len(left) - len(gone), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def written(spark, folder, parts, schema="doc_id long, text string, lang string"):
    """A file for each part, read one a batch, in this order."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        for f in os.listdir(f"{folder}/in/{k}"):
            os.utime(f"{folder}/in/{k}/{f}", (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_smaller_ids_that_come_later_retract(spark, tmp_path):
    texts = [LONG, LONG + " %", "a b a b", "AB CD", None, "", "SHORT $"]
    rows = [(k * 7 % 60, texts[k % 7], [None, "en", "de"][k % 3]) for k in range(60)] + [(3, LONG, "en"), (3, LONG, "de"), (3, LONG, "en"), (None, LONG, "en"), (None, LONG, "en"), (None, None, None)]
    rows.sort(key=lambda r: (-(r[0] or 0), str(r)))  # the smallest ids come last
    labels = {3: (1, 0), 7: (0, 1), 14: (1, 1), 21: (1, 0), 59: (0, 1)}
    frame = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    stream = written(spark, str(tmp_path), [rows[at : at + 11] for at in range(0, len(rows), 11)])
    counted = filter_audit.counters(stream, frame, 3, str(tmp_path / "work"))
    assert audited(filter_audit.audit(counted)) == brute(rows, labels)
    # something was retracted, and a run that goes on from its state adds nothing
    changes = spark.read.parquet(str(tmp_path / "work/changes"))
    assert changes.filter("change < 0").count() and changes.select("batch").distinct().count() > 3
    assert audited(filter_audit.audit(filter_audit.counters(stream, frame, 3, str(tmp_path / "work")))) == brute(rows, labels)


def test_order_of_files_does_not_matter(spark, tmp_path):
    rows = [(k, LONG if k % 2 else f"{LONG} {k % 5}", "en") for k in range(40)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for n, some in enumerate((rows, rows[::-1], rows[1::2] + rows[::2])):
        stream = written(spark, str(tmp_path / str(n)), [some[:15], some[15:16], some[16:]])
        assert audited(filter_audit.audit(filter_audit.counters(stream, labels, 2, str(tmp_path / f"w{n}")))) == brute(rows, {})


def test_query_against_brute_force_and_sql(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = filter_audit.query(spark, sf_dir)
    assert dict(got.dtypes)["step"] == "int"
    assert audited(got) == brute(docs, labels)
    base = duckdb.connect()
    for t in ("documents", "labels"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = base.sql(f"SELECT {', '.join(got.columns)} FROM ({filter_audit.ORACLE_SQL})").fetchall()
    assert {tuple(r) for r in got.collect()} == set(want)


def test_empty_table_long_text_and_extra_columns(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, mask int, id string, n int"
    stream = written(spark, str(tmp_path / "a"), [[]], schema)
    assert filter_audit.audit(filter_audit.counters(stream, labels, 1, str(tmp_path / "wa"))).count() == 0
    long = " ".join(f"w{k % 90_000}" for k in range(100_000))
    stream = written(spark, str(tmp_path / "b"), [[(2, long, "en", 1, "x", 1)], [(1, long, "fr", 1, "x", 1)]], schema)
    counted = filter_audit.counters(stream, labels, 1, str(tmp_path / "wb"))
    assert sorted(map(tuple, counted.filter("n > 0").select("part", "mask", F.col("good") > 0, "n").collect())) == [("en", 16, False, 1), ("fr", 0, True, 1)]
