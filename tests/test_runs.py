import json

import pytest
from docquery.operators import catalogue, evaluation, metrics
from docquery.plans import run_plans
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_bytes("café ".encode() + b"\xff!")
    (tmp_path / "deep" / "b.MD").write_text("# T")
    (tmp_path / "c.xyz").write_text("no")
    got = {r.filename: r.text for r in catalogue.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "café !", "b.MD": "# T"}
    assert {r.filename for r in catalogue.read_files(spark, str(tmp_path), recursive=False).collect()} == {"a.txt"}


def test_store_is_partitioned(spark, tmp_path):
    from docquery.sources import fixtures as fx

    catalogue.write_store(fx.chunks(spark, SF).drop("embedding"), str(tmp_path / "store"))
    plan = spark.read.parquet(str(tmp_path / "store")).filter("department = 'D1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(department" in plan


def test_cases_and_report(spark, tmp_path):
    cases = [{"id": f"c{i}", "category": "x", "question": "q", "ground_truth": None if i == 2 else "g"} for i in range(5)]
    (tmp_path / "cases.json").write_text(json.dumps({"test_cases": cases}, indent=1))
    got = evaluation.read_cases(spark, str(tmp_path / "cases.json"), 3).orderBy("place").collect()
    assert [r.id for r in got] == ["c0", "c1", "c2"] and got[2].ground_truth is None
    evaluation.write_report(spark.createDataFrame([("c0", None), ("c1", "failed")], "query_id string, error string"), str(tmp_path / "report"), "k=5")
    assert spark.read.json(str(tmp_path / "report")).filter("error = 'failed'").count() == 1


def test_a_run_goes_on_after_failed_cases(spark):
    rows = run_plans.evaluated(spark, SF).collect()
    bad = [r for r in rows if r.error]
    assert bad and all((r.query_id // 100) % 11 == 0 and r.overall is None for r in bad)
    for r in (x for x in rows if not x.error):
        total = 0.4 * (r.precision + r.recall + r.ndcg) / 3 + 0.4 * (r.bleu + r.rouge_l + r.faithfulness) / 3 + 0.2 * (r.context_precision + r.context_recall + r.citation_accuracy) / 3
        assert r.overall == pytest.approx(total / 2 if r.hallucinated else total, abs=6e-4)
        assert all(0 <= x <= 1 for x in (r.precision, r.recall, r.bleu, r.rouge_l, r.faithfulness, r.citation_accuracy))


def test_stop_words_and_similarity():
    words = metrics.stop_words()
    assert len(words) == 318 and list(words) == sorted(words) and {"amoungst", "sincere", "yourselves", "system"} <= set(words) and "just" not in words


def test_prompts_end_with_the_question(spark):
    rows = run_plans.prompts(spark, SF).select(F.element_at("messages", -1)["content"].alias("last"), F.size("messages").alias("n")).collect()
    assert rows and all("QUESTION: " in r.last and 2 <= r.n <= 8 for r in rows)


def test_decoding_keeps_what_a_file_really_holds(spark):
    from docquery.operators import catalogue

    raw = [b"plain", b"a\xff\xef\xbf\xbdb\xee\x80\x80\xc3", b"\xef\xbf\xbd ok", b"\xee\x80\x801\xfe", None]
    frame = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raw)], "k int, content binary")
    got = {r.k: r.t for r in frame.select("k", catalogue.decoded(frame.content).alias("t")).collect()}
    assert got == {0: "plain", 1: "a�b", 2: "� ok", 3: "1", 4: None}


def test_a_bad_file_is_a_failed_row(spark):
    from docquery.operators import catalogue

    files = spark.createDataFrame([("1", "a.txt", "x", None), ("2", "b.exe", "x", None), ("3", "c.md", None, None), ("4", "d.md", "x", "[[[1"), ("5", "e", "x", None), ("6", "f.md", "", '[[["a"]]]')], "document_id string, filename string, text string, tables string")
    log = catalogue.ingest_log(catalogue.parsed(files, tables="tables"), spark.createDataFrame([("1",), ("1",), ("4",)], "document_id string"))
    got = {r.document_id: (r.status, r.error, r.chunks_count, r.tables_count) for r in log.collect()}
    assert got == {"1": ("completed", None, 2, 0), "2": ("failed", "Unsupported file format: .exe", 0, 0), "3": ("failed", "No content", 0, 0), "4": ("failed", "Malformed tables in d.md", 0, 0), "5": ("failed", "Unsupported file format: ", 0, 0), "6": ("warning", None, 0, 1)}


def test_section_tables(spark):
    from docquery.operators import tables as tb

    rows = [("d", 0, "table", None, [["a ", None]]), ("d", 1, "heading", " One ", None), ("d", 2, "paragraph", "x", None), ("d", 3, "table", None, [["h"], [" 1 "], ["2"]]), ("d", 4, "heading", " ", None), ("d", 5, "table", None, []), ("d", 6, "table", None, [["k"]])]
    got = tb.section_tables(spark.createDataFrame(rows, "document_id string, place int, type string, text string, rows array<array<string>>")).orderBy("place").collect()
    assert [(r.name, r.section, r.headers, r.rows) for r in got] == [("Table_1rows", "", ["a", ""], []), ("Table_3rows", "One", ["h"], [["1"], ["2"]]), ("Table_1rows", "One", ["k"], [])]
