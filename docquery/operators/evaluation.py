"""Evaluation runs: reading cases, joining metric frames, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.operators import metrics

CASES = "test_cases array<struct<id:string,category:string,question:string,ground_truth:string>>"


def read_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Cases of an evaluation file in order: (place, id, category, question, ground_truth)."""
    found = spark.read.schema(CASES).json(path, multiLine=True).select(F.posexplode("test_cases").alias("place", "c")).select("place", "c.*")
    return found if limit is None else found.filter(F.col("place") < limit)


def evaluated(cases: DataFrame, ranked: DataFrame, answers: DataFrame, *, stems: bool = False) -> DataFrame:
    """All metrics of each case (query_id, category): ranking metrics joined with the text metrics of its answer (question, answer, cited, context, ground_truth).

    Without a ground truth the answer stands in for it, as a run without references
    has it. A case without an answer or without chunks is a row with an error; the
    run goes on. ``stems``: ROUGE-L compares stems.
    """
    a, c, truth = F.col("answer"), F.col("context"), F.col("ground_truth")
    reference = F.when(F.coalesce(truth, F.lit("")) != "", truth).otherwise(a)
    text = answers.select(
        "query_id",
        metrics.bleu(reference, a).alias("bleu"),
        metrics.rouge_l(reference, a, stems=stems).alias("rouge_l"),
        metrics.similarity(F.col("question"), a).alias("answer_relevancy"),
        metrics.grounding(a, c).alias("g"),
        metrics.citation_accuracy(F.col("cited"), c).alias("citation_accuracy"),
        F.when(F.coalesce(truth, F.lit("")) != "", metrics.similarity(a, truth)).alias("answer_correctness"),
    ).select("*", "g.*").drop("g").withColumn("answer_correctness", F.coalesce("answer_correctness", "faithfulness"))  # as metrics.correctness has it
    out = cases.select("query_id", "category").join(ranked, "query_id", "left").join(text, "query_id", "left")
    out = out.withColumn("error", F.when(F.col("bleu").isNull() | (F.coalesce("n_retrieved", F.lit(0)) == 0), F.lit("no chunks or no answer")))
    total = metrics.overall(*[F.col(x) for x in ("precision", "recall", "ndcg", "bleu", "rouge_l", "faithfulness", "context_precision", "context_recall", "citation_accuracy", "hallucinated")])
    return out.withColumn("semantic_similarity", F.col("answer_relevancy")).withColumn("overall", F.when(F.col("error").isNull(), total))


#: The parts of a nested result and what each holds.
PARTS = {
    "retrieval": ("precision", "recall", "f1", "mrr", "ndcg"),
    "generation": ("bleu", "rouge_l", "semantic_similarity", "answer_relevancy", "faithfulness"),
    "end_to_end": ("context_precision", "context_recall", "context_f1", "citation_accuracy", "answer_correctness"),
}


def projected(results: DataFrame) -> DataFrame:
    """Nested results, three digits, with the number of chunks retrieved."""
    part = lambda names: F.struct(*[F.round(n, 3).alias(n) for n in names])
    return results.select("query_id", "category", *[part(names).alias(p) for p, names in PARTS.items()], F.col("hallucinated").alias("hallucination_detected"), F.col("n_retrieved").alias("chunks_retrieved"), "overall", "error")


def displayed(results: DataFrame) -> DataFrame:
    """A line for each case that went through: two digits, a mark for no hallucination, twelve characters of the category."""
    number = lambda c: F.format_string("%.2f", F.round(c, 2)).alias(c)
    return results.filter("error is null").select("query_id", F.substring("category", 1, 12).alias("category"), *[number(c) for c in ("precision", "recall", "ndcg", "bleu", "faithfulness", "context_f1", "overall")], F.when(F.col("hallucinated"), "✗").otherwise("✓").alias("hallucination"))


def write_report(results: DataFrame, path: str, config: str, at: Column | None = None) -> None:
    """Results as JSON lines with the time and the configuration of the run; failed cases are rows with an error."""
    results.withColumns({"timestamp": F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss"), "config": F.lit(config)}).write.mode("overwrite").json(path)
