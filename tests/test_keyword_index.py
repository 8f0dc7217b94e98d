"""The stored keyword index gives what the search over documents gives, and reads less."""

from docquery.operators import keyword_index, search
from docquery.sources import fixtures as fx
from docquery.sources.tables import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_equals_the_search_over_documents(spark, tmp_path):
    docs, path = table(spark, SF, "documents").select("doc_id", "text"), str(tmp_path / "i")
    keyword_index.append(docs.filter("doc_id % 3 > 0"), path)
    keyword_index.append(docs.filter("doc_id % 3 = 0"), path)
    asked = fx.questions(spark, SF)
    for batch in (asked.filter("conv_id % 50 = 0"), asked.filter("conv_id % 50 = 7")):
        got = keyword_index.search(spark, path, batch, 10)
        assert "documents.parquet" not in got._jdf.queryExecution().toString()
        want = search.bm25(docs, batch, 10)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_levels_are_pruned_and_hot_terms_split(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "common ").otherwise("other "), F.repeat(F.lit("filler "), (F.col("id") % 50).cast("int")), F.when(F.col("id") % 1000 == 1, "rare rare").otherwise("")).alias("text"))
    keyword_index.append(docs, path, partitions=16)
    queries = spark.createDataFrame([(1, "rare common filler"), (2, "common"), (3, "nowhere"), (4, ""), (5, "filler")], "query_id long, question string")
    assert sorted(map(tuple, keyword_index.search(spark, path, queries, 5).collect())) == sorted(map(tuple, search.bm25(docs, queries, 5).collect()))
    for asked, leads, share in (("query_id = 1", "leads", 0.01), ("query_id = 5", "true", 0.5)):
        own = queries.filter(asked)
        read = keyword_index.needed(spark, path, own, 5).filter(leads).agg(F.sum("postings")).head()[0]
        assert read < keyword_index.plan(spark, path, own, 5).agg(F.sum("postings")).head()[0] * share
    files = spark.read.parquet(f"{path}/postings").filter("term = 'common'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1


def test_empty(spark, tmp_path):
    path = str(tmp_path / "i")
    none = spark.createDataFrame([], "doc_id long, text string")
    keyword_index.append(none, path)
    queries = spark.createDataFrame([(1, "word")], "query_id long, question string")
    assert keyword_index.search(spark, path, queries, 5).count() == 0
    keyword_index.append(spark.createDataFrame([(1, None), (2, "word"), (2, "word word")], "doc_id long, text string"), path)
    assert [r.doc_id for r in keyword_index.search(spark, path, queries, 5).collect()] == [2]
