"""Counters and rates over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "endpoint", "status").agg(F.count("*").alias("requests"))


def durations(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "endpoint").agg(F.count("*").alias("observations"), F.round(F.sum("latency_ms"), 4).alias("total_ms"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))


#: Size of a quantile sketch; its ranks are off by half a percent or less with a probability of 0.99.
SKETCH_K = 600


def duration_sketches(log: DataFrame, span: str = "day") -> DataFrame:
    """A sketch of the durations of each span, method and endpoint: some kilobytes whatever their number, to be kept and merged."""
    return log.groupBy(F.date_trunc(span, F.col("asked_at").cast("timestamp")).alias("span"), "method", "endpoint").agg(F.kll_sketch_agg_double("latency_ms", SKETCH_K).alias("sketch"))


def duration_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Quantiles by method and endpoint over all spans, from merged sketches: (method, endpoint, observations, quantile, latency_ms)."""
    merged = sketches.groupBy("method", "endpoint").agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    each = [F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("latency_ms")) for q in quantiles]
    return merged.select("method", "endpoint", F.kll_sketch_get_n_double("sketch").alias("observations"), F.inline(F.array(*each)))


def model_totals(log: DataFrame) -> DataFrame:
    """Successes, failures, tokens in and out of successes, fallbacks, success rate in percent and mean latency over all requests."""
    good = F.col("status") < 500
    n = F.greatest(F.count("*"), F.lit(1))
    return log.agg(
        F.count("*").alias("total_requests"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
        *[F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")],
        F.count_if("fallback").alias("fallbacks"),
        F.round(100.0 * F.count_if(good) / n, 2).alias("success_rate"),
        F.round(F.coalesce(F.sum("latency_ms"), F.lit(0.0)) / n, 2).alias("average_latency_ms"),
    )


def hit_rate(replayed: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate in percent; 0 without traffic."""
    return replayed.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.coalesce(100.0 * F.count_if("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 2).alias("hit_rate"))


def exposition(counts: DataFrame, name: str, labels: list[str], value: str, kind: str = "counter") -> DataFrame:
    """Rows of a text exposition: name, labels, type, value and the line."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return counts.select(F.lit(name).alias("name"), pairs.alias("labels"), F.lit(kind).alias("type"), F.col(value).cast("double").alias("value")).withColumn("line", F.concat("name", F.lit("{"), "labels", F.lit("} "), F.col("value").cast("string")))




def snapshot(log: DataFrame, replayed: DataFrame, processed: DataFrame) -> DataFrame:
    """All totals in one nested row: requests in all and by method and endpoint, models, cache and documents (``processed``: one row of totals)."""
    ends = request_counts(log).groupBy("method", "endpoint").agg(F.sum("requests").alias("n"))
    http = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "method", "endpoint").alias("k"), "n")))).alias("requests_by_endpoint"))
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    out = one(http, "http")
    for part in (one(model_totals(log), "llm"), one(hit_rate(replayed), "cache"), one(processed, "documents")):
        out = out.join(F.broadcast(part))  # one row each
    return out
