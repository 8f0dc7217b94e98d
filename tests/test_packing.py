"""The streamed packer against the column folds, with counters of other kinds."""

import re

import pandas as pd
from docquery.functions.loaded import Loaded
from docquery.operators import chunking, packing
from docquery.plans import text_plans
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tests.test_chunking import SF, packed, sentences

SCHEMA = "document_id string, block_idx int, type string, text string, page_number int, section string"


def odd_blocks(spark):
    found = text_plans.blocks(spark, SF).withColumn("type", F.when(F.col("block_idx") % 13 == 5, "title").otherwise(F.col("type"))).select(SCHEMA.replace(" string", "").replace(" int", "").split(", "))
    rows = [("a", 0, "paragraph", "w" * 3000, None, None), ("a", 1, "heading", "# h", 0, "h"), ("a", 2, "paragraph", "wor " * 2000, 2, "h"), ("a", 3, "paragraph", "", 3, ""), ("b", 0, "paragraph", "Short one. " * 900, 1, "s"), ("b", 1, "paragraph", "Long. " * 300, 1, "s"), ("b", 2, "title", "T", None, None), (None, 0, "paragraph", "x " * 90, 1, "")]
    return found.unionByName(spark.createDataFrame(rows, SCHEMA))


def chunks_of(df):
    return sorted(map(str, (tuple(r) for r in df.select("document_id", "chunk_index", "content", "page_numbers", "sections", "token_count").collect())))


def test_blocks_equal_the_column_fold(spark):
    blocks = odd_blocks(spark)
    for leak in (False, True):
        assert chunks_of(packing.pack_blocks(blocks, 120, 25, 30, leak=leak)) == chunks_of(chunking.pack_blocks(blocks, 120, 25, 30, leak=leak))


def test_sentences_equal_the_rules(spark):
    rows = {r.document_id: r.text for r in text_plans.fx.files(spark, SF).collect()} | {"a": "w" * 3000, "b": ("wor " * 3000).strip(), "c": "", "d": "Short one. " * 400, "e": None}
    got = {}
    for r in packing.pack_sentences(spark.createDataFrame(list(rows.items()), "document_id string, text string"), 120, 25).orderBy("chunk_index").collect():
        got.setdefault(r.document_id, []).append(r.content)
    assert got == {d: c for d, t in rows.items() if t for c in [sentences(t, 120, 25)] if c}


def by_words(texts: pd.Series) -> pd.Series:
    """Tokens as a real counter has them: not additive over joined texts."""
    return texts.map(lambda t: len(re.findall(r"\w{1,4}|[^\w\s]", t)))


def test_a_pandas_counter_and_a_loaded_one(spark, monkeypatch, tmp_path):
    blocks = text_plans.blocks(spark, SF).filter("document_id < '15'")
    rows = {}
    for r in blocks.orderBy("document_id", "block_idx").collect():
        rows.setdefault(r.document_id, []).append((r.type, r.text, r.page_number))
    import tests.test_chunking as plain

    monkeypatch.setattr(plain, "n", lambda t: int(by_words(pd.Series([t]))[0]))
    want = sorted((d, k, t, p) for d, bs in rows.items() for k, (t, p) in enumerate(packed(bs, 90, 20, 25)))
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as f:
            f.write("x")
        return packing.by_pandas(by_words)

    for counter in (packing.by_pandas(by_words), packing.by_pandas(F.pandas_udf(by_words, IntegerType())), Loaded(load)):
        got = packing.pack_blocks(blocks.repartition(16), 90, 20, 25, counter=counter).collect()
        assert sorted((r.document_id, r.chunk_index, r.content, r.page_numbers) for r in got) == want
        assert all(r.token_count == by_words(pd.Series([r.content]))[0] for r in got)
    # a worker process loads once, not each task
    assert 1 <= len(open(loads).read()) <= 8


def test_a_document_of_very_many_pieces(spark):
    many = spark.range(60_000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("block_idx"), F.lit("paragraph").alias("type"), F.concat(F.lit("Sentence number "), F.col("id"), F.lit(".")).alias("text"), F.lit(1).alias("page_number"), F.lit("s").alias("section"))
    one = spark.createDataFrame([("e", 0, "paragraph", "One more sentence. " * 200_000, 1, "s")], SCHEMA)
    out = packing.pack_blocks(many.unionByName(one), 100, 10, 5)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r.document_id: r for r in out.groupBy("document_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.max("token_count").alias("most"), F.sum(F.length("content")).alias("chars")).collect()}
    assert all(r.n == r["last"] + 1 and r.most <= 100 for r in got.values())
    assert got["d"].chars > 1_200_000 and got["e"].chars > 3_700_000


def test_empty(spark):
    assert packing.pack_blocks(spark.createDataFrame([], SCHEMA)).count() == 0
