"""Evaluation metrics over whole sets of queries: ranking, text and summary."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docquery.config import DEFAULTS
from docquery.functions import stemmer
from docquery.functions.text import counts, let

#: Pairs of texts whose words are Python objects, or numbers, at once.
ROWS = 128
#: Weight of a word that only one of two texts has: ln(1.5) + 1.
ALONE = 1.0 + 0.4054651081081644
#: English words without a topic, one a line: the built-in list of the usual TF-IDF vectoriser. Another file may be named.
STOP_WORDS_FILE = Path(__file__).parent.parent / "functions" / "stop_words_en.txt"


@functools.cache
def stop_words(path: str | Path = STOP_WORDS_FILE) -> tuple[str, ...]:
    return tuple(Path(path).read_text(encoding="utf-8").split())


def ranking(queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Ranking metrics for each query of ``queries`` (query_id) from retrieved (query_id, rank, id) and relevant (query_id, id).

    precision and recall count distinct hits; nothing relevant gives recall 1, nothing
    retrieved gives context precision 1. The ideal of nDCG has as many hits as are
    relevant, ``k`` at most.
    """
    wanted = relevant.select("query_id", "id").distinct()
    hit = retrieved.join(wanted.withColumn("hit", F.lit(True)), ["query_id", "id"], "left")
    return _ranked(queries, hit, wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant")), k)


def ranking_by_label(queries: DataFrame, retrieved: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """As ``ranking``, where the items (id, label) of a query's own label (query_id, label) are relevant, itself left out. No pair of a query and an item is formed but the retrieved ones: labels are counted for the denominators."""
    own = items.select(F.col("id").alias("query_id"), F.lit(1).alias("self"), F.col("label").alias("own"))
    sizes = queries.join(items.groupBy("label").agg(F.count("*").alias("n")), "label", "left").join(own, "query_id", "left")
    n = F.coalesce("n", F.lit(0)) - F.when(F.col("own") == F.col("label"), F.col("self")).otherwise(0)
    hit = retrieved.join(items.select("id", F.col("label").alias("found")), "id", "left").join(queries.select("query_id", "label"), "query_id", "left")
    hit = hit.withColumn("hit", F.coalesce((F.col("found") == F.col("label")) & (F.col("id") != F.col("query_id")), F.lit(False)))
    return _ranked(queries, hit, sizes.select("query_id", n.alias("n_relevant")), k)


def _ranked(queries: DataFrame, hit: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    found = hit.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("hit") & (F.col("rank") <= k), F.col("id"))).alias("hits_k"),
        F.countDistinct(F.when(F.col("hit"), F.col("id"))).alias("hits"),
        F.countDistinct("id").alias("n_retrieved"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("hit") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = queries.select("query_id").join(found, "query_id", "left").join(sizes, "query_id", "left").select("query_id", zero("hits_k").alias("hits_k"), zero("hits").alias("hits"), zero("n_retrieved").alias("n_retrieved"), "first", F.coalesce("dcg", F.lit(0.0)).alias("dcg"), zero("n_relevant").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    out = joined.withColumns(
        {
            "precision": F.col("hits_k") / float(max(k, 1)) if k else F.lit(0.0),
            "recall": F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.col("hits_k") / F.nullif(F.col("n_relevant"), F.lit(0))),
            "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)),
            "ndcg": F.when(F.col("n_relevant") == 0, 0.0).otherwise(F.col("dcg") / ideal),
            "context_precision": F.when(F.col("n_retrieved") == 0, 1.0).otherwise(F.col("hits") / F.nullif(F.col("n_retrieved"), F.lit(0))),
            "context_recall": F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.col("hits") / F.nullif(F.col("n_relevant"), F.lit(0))),
        }
    )
    out = out.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "context_f1": f1(F.col("context_precision"), F.col("context_recall"))})
    names = ["precision", "recall", "f1", "mrr", "ndcg", "context_precision", "context_recall", "context_f1"]
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in names], "n_retrieved")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def topic_words(text: Column, stops: tuple[str, ...] | None = None) -> Column:
    """Words of two or more letters, digits or underscores that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*(stop_words() if stops is None else stops)))


def _parts(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of ``ROWS`` rows, whatever the size of the batch."""
    for at in range(0, len(columns[0]), ROWS):
        yield tuple(c.slice(at, ROWS) for c in columns)


def _owners(c: pa.Array) -> np.ndarray:
    """Of each item of a column of lists the row."""
    return np.repeat(np.arange(len(c)), pc.fill_null(c.value_lengths(), 0).to_numpy())


def _numbered(*columns: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Columns of lists of words as pairs, the row and the number of each word, and how many numbers there are; a list that is null has no words."""
    flat = [c.flatten() for c in columns]
    # arrays without items may come without buffers, which can't be joined
    coded = pa.concat_arrays([f for f in flat if len(f)] or [pa.array([], pa.string())]).dictionary_encode()
    cuts = np.cumsum([len(f) for f in flat])[:-1]
    return list(zip(map(_owners, columns), np.split(coded.indices.to_numpy().astype(np.int64), cuts), strict=True)), max(1, len(coded.dictionary))


def _cosines(texts: np.ndarray, others: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Similarity of each text with the other one of its ``row``. A word of ``texts`` is the text's number times ``size`` plus its own, one of ``others`` the row's times ``size`` plus its own."""
    (x, nx), (y, ny) = (np.unique(w, return_counts=True) for w in (texts, others))
    owner, most = x // size, len(row)
    wanted = row[owner] * size + x % size
    at = np.minimum(np.searchsorted(y, wanted), max(0, len(y) - 1))
    both = y[at] == wanted if len(y) else np.zeros(len(x), bool)
    mine, theirs, of = nx[both], ny[at[both]], owner[both]
    # sums of whole numbers, so that their order does not matter
    norm = lambda every, shared: np.sqrt(shared + ALONE * ALONE * (every - shared))
    every_other = np.bincount(y // size, ny * ny, int(row.max(initial=-1)) + 1)[row]
    norms = norm(np.bincount(owner, nx * nx, most), np.bincount(of, mine * mine, most)) * norm(every_other, np.bincount(of, theirs * theirs, most))
    return np.divide(np.bincount(of, mine * theirs, most), norms, out=np.zeros(most), where=norms > 0)


@F.arrow_udf(ArrayType(DoubleType()))
def _likenesses(texts: pa.Array, other: pa.Array) -> pa.Array:
    """Of each row's texts, lists of topic words, the similarity with the row's other text. Words are numbers that are sorted and looked up by bisection; a map column's entries are tried one after the other, which takes the product of two texts' sizes."""
    found = []
    for some, one in _parts(texts, other):
        each = some.flatten()
        row = _owners(some)
        ((text, x), (of, y)), size = _numbered(each, one)
        values = _cosines(text * size + x, of * size + y, row, size)
        ends = np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32)
        found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=some.is_null()))
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float64()))


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two texts' TF-IDF vectors fitted on these two alone: a word in both weighs 1, in one ln(1.5) + 1. 0 where either has no words."""
    return _likenesses(F.array(topic_words(a)), topic_words(b))[0]


def grams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by blanks."""
    return let(tokens, lambda t: F.when(F.size(t) < n, F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))))


def clipped(a: Column, b: Column) -> Column:
    """Items of ``a`` found in ``b``, each as often as in both."""
    return let(counts(a), lambda x: let(F.map_from_entries(counts(b)), lambda m: F.aggregate(x, F.lit(0).cast("long"), lambda s, e: s + F.least(e["n"], F.coalesce(F.try_element_at(m, e["w"]), F.lit(0))))))


def _runs(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*[tokens[k:] for k in range(n)], strict=False))


def _bleu(matches: list[int], r: int, h: int) -> float:
    """From the matching runs of one to four words and the two lengths."""
    if not matches[0]:
        return 0.0
    logs = math.log(matches[0] / h)
    for n in range(2, 5):
        logs += math.log((matches[n - 1] or 0.1) / max(h - n + 1, 1))
    return (1.0 if h > r else math.exp(1 - r / h)) * math.exp(logs / 4)


def _matches(r: tuple[np.ndarray, np.ndarray], h: tuple[np.ndarray, np.ndarray], rows: int, size: int) -> np.ndarray:
    """For each row how many runs of one to four words two texts share, each as often as in both. Words are numbers below ``size``."""
    row = np.concatenate((r[0], h[0] + rows))
    word = runs = np.concatenate((r[1], h[1]))
    found = np.zeros((rows, 4), np.int64)
    for n in range(1, 5):
        if n > 1:  # a run is the number of the one before it and a word
            runs = np.unique(runs[:-1] * size + word[n - 1 :], return_inverse=True)[1]
        first = row[: len(runs)]
        whole = first == row[n - 1 :]
        most = int(runs.max(initial=0)) + 1
        (x, nx), (y, ny) = (np.unique((first[own] % rows) * most + runs[own], return_counts=True) for own in (whole & (first < rows), whole & (first >= rows)))
        both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        found[:, n - 1] = np.bincount(both // most, np.minimum(nx[i], ny[j]), rows)
    return found


def _pairs(r: pa.Array, h: pa.Array) -> Iterator[tuple[list[str] | None, list[str] | None]]:
    """Pairs of lists of words, of which ``ROWS`` at a time are Python objects, whatever the size of the batch."""
    for x, y in _parts(r, h):
        yield from zip(x.to_pylist(), y.to_pylist(), strict=True)


def _sizes(row: np.ndarray, rows: int) -> list[int]:
    return np.bincount(row, minlength=rows).tolist()


@F.arrow_udf(DoubleType())
def _bleus(r: pa.Array, h: pa.Array) -> pa.Array:
    found: list[float] = []
    for part in _parts(r, h):
        (x, y), size = _numbered(*part)
        rows = len(part[0])
        found += map(_bleu, _matches(x, y, rows, size).tolist(), _sizes(x[0], rows), _sizes(y[0], rows))
    return pa.array(found, pa.float64())


def bleu(reference: Column, hypothesis: Column) -> Column:
    """BLEU-4 with equal weights; an order without a match counts as 0.1 matches (smoothing method 1). 0 without any matching word. Words are split once; their runs are numbers that are counted for many pairs at once."""
    return _bleus(words(reference), words(hypothesis))


def _plain(text: Column) -> Column:
    """Words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def rouge_n(reference: Column, hypothesis: Column, n: int, *, stems: bool = False) -> Column:
    """ROUGE-n F-measure on words of letters and digits; with ``stems`` on their stems, counted an Arrow batch at a time."""
    if stems:
        return _stemmed_rouge(n)(_plain(reference), _plain(hypothesis))
    r, h = grams(_plain(reference), n), grams(_plain(hypothesis), n)
    return _f(clipped(h, r).cast("double"), F.size(h), F.size(r))


def _stemmed_rouge(n: int | None):
    """ROUGE-n of stems, ROUGE-L where ``n`` is None."""

    def one(r: list[str], h: list[str]) -> float:
        r, h = (stemmer.stems(x or []) for x in (r, h))
        if n is None:
            match, size = _longest_common(r, h), len(r) + len(h)
        else:
            a, b = _runs(r, n), _runs(h, n)
            match, size = sum((a & b).values()), a.total() + b.total()
        return 2 * match / size if match else 0.0

    @F.arrow_udf(DoubleType())
    def score(r: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([one(x, y) for x, y in _pairs(r, h)], pa.float64())

    return score


def _f(match: Column, size_h: Column, size_r: Column) -> Column:
    p, q = match / F.nullif(size_h, F.lit(0)), match / F.nullif(size_r, F.lit(0))
    return F.coalesce(2 * p * q / F.nullif(p + q, F.lit(0.0)), F.lit(0.0))


def _longest_common(r: list[str], h: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict[str, int] = {}
    for i, w in enumerate(r):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(r)) - 1
    row = full
    for w in h:
        both = row & places.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(r) - row.bit_count()


@F.arrow_udf(DoubleType())
def _lcs(r: pa.Array, h: pa.Array) -> pa.Array:
    """ROUGE-L F-measure."""
    found: list[float] = []
    for part in _parts(r, h):
        columns, _ = _numbered(*part)
        x, y = ([w.tolist() for w in np.split(words, np.searchsorted(row, np.arange(1, len(part[0]))))] for row, words in columns)
        for a, b in zip(x, y, strict=True):
            match = _longest_common(a, b) if a and b else 0
            p, q = match / max(1, len(b)), match / max(1, len(a))
            found.append(2 * p * q / (p + q) if match else 0.0)
    return pa.array(found, pa.float64())


def rouge_l(reference: Column, hypothesis: Column, *, stems: bool = False) -> Column:
    """ROUGE-L F-measure on words of letters and digits, with ``stems`` on their stems. The longest common subsequence is a fold that no column function does in linear memory: an Arrow batch at a time in Python, of words' numbers."""
    return (_stemmed_rouge(None) if stems else _lcs)(_plain(reference), _plain(hypothesis))


def faithfulness(answer: Column, context: Column, at: float = DEFAULTS.faithful_at) -> Column:
    """Share of an answer's sentences that are similar to the context; 0 without sentences."""
    return _share(_likenesses(F.transform(_sentences(answer), lambda s: topic_words(s)), topic_words(context)), at)


def _sentences(answer: Column) -> Column:
    return F.filter(F.transform(F.split(answer, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _share(likenesses: Column, at: float) -> Column:
    return let(likenesses, lambda s: F.when(F.size(s) == 0, 0.0).otherwise(F.size(F.filter(s, lambda x: x >= at)) / F.size(s)))


def _new_numbers(answer: Column, context: Column) -> Column:
    """Whether over 30 % of the answer's numbers are new."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    new = F.size(F.array_except(numbers(answer), numbers(context))) / F.nullif(F.size(numbers(answer)), F.lit(0)).cast("double")
    return F.coalesce(new > DEFAULTS.new_numbers_over, F.lit(False))


def hallucinated(answer: Column, context: Column) -> Column:
    """Whether over 30 % of the answer's numbers are new, or the answer is unlike the context."""
    return _new_numbers(answer, context) | (similarity(answer, context) < DEFAULTS.dissimilar_under)


def grounding(answer: Column, context: Column, at: float = DEFAULTS.faithful_at) -> Column:
    """``faithfulness`` and ``hallucinated`` as one struct, for which the context's words are counted once: the answer is compared as a whole and by sentences."""
    texts = F.concat(F.array(topic_words(answer)), F.transform(_sentences(answer), lambda s: topic_words(s)))
    likenesses = _likenesses(texts, topic_words(context))
    # an answer that is null is like nothing
    whole = F.coalesce(likenesses[0], F.lit(0.0))
    return F.struct(_share(F.slice(likenesses, F.lit(2), F.size(likenesses)), at).alias("faithfulness"), (_new_numbers(answer, context) | (whole < DEFAULTS.dissimilar_under)).alias("hallucinated"))


def citation_accuracy(answer: Column, context: Column) -> Column:
    """Share of ``[Source n: …]`` citations whose text, or one of its first two words, is in the context; 0 without citations."""
    cited = F.regexp_extract_all(answer, F.lit(r"\[Source [0-9]+: ([^\]]+)\]"), F.lit(1))
    known = lambda c: context.contains(c) | F.exists(F.slice(F.filter(F.split(c, r"\s+"), lambda w: w != ""), 1, 2), lambda w: context.contains(w))
    return let(cited, lambda cs: F.when(F.size(cs) == 0, 0.0).otherwise(F.size(F.filter(cs, known)) / F.size(cs)))


def correctness(answer: Column, ground_truth: Column, context: Column) -> Column:
    """Similarity with the ground truth; where there is none, faithfulness."""
    return F.when(F.coalesce(ground_truth, F.lit("")) != "", similarity(answer, ground_truth)).otherwise(faithfulness(answer, context))


def overall(p: Column, r: Column, ndcg: Column, bleu_: Column, rouge: Column, faithful: Column, context_p: Column, context_r: Column, cite: Column, hallucination: Column) -> Column:
    """0.4 of the mean of ranking, 0.4 of text (BLEU, ROUGE-L, faithfulness) and 0.2 of context metrics; halved on hallucination; three digits."""
    total = 0.4 * (p + r + ndcg) / 3 + 0.4 * (bleu_ + rouge + faithful) / 3 + 0.2 * (context_p + context_r + cite) / 3
    return F.round(F.when(hallucination, total / 2).otherwise(total), 3)


#: The means at which a run passes.
PASS_MARKS = {"precision": 0.7, "recall": 0.7, "ndcg": 0.75, "bleu": 0.5, "faithfulness": 0.8}


def summary(results: DataFrame) -> DataFrame:
    """Of a run's results (error is null where a case went through): cases and valid ones, the means of the valid ones' metrics, each rounded to three digits before averaging, the number of hallucinations, and what passes."""
    good = F.col("error").isNull()
    mean = lambda c: F.round(F.avg(F.when(good, F.round(c, 3))), 6)
    means = results.agg(F.count("*").alias("total"), F.count_if(good).alias("valid"), *[mean(c).alias(f"mean_{c}") for c in (*PASS_MARKS, "context_precision")], F.count_if(good & F.col("hallucinated")).alias("hallucinations"))
    return means.withColumns({**{f"{c}_passes": F.col(f"mean_{c}") >= m for c, m in PASS_MARKS.items()}, "no_hallucination": F.col("hallucinations") == 0})
