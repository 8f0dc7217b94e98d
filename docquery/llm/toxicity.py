"""Toxicity of obfuscated text by a noisy channel.

A character trigram model is counted over all documents. What looks disguised (digits
or symbols among letters, letters in a row, runs of short pieces set apart) is read as
a lattice: each written character may stand for itself, for the letters it imitates,
for a repeat of the letter before or for nothing, and each blank or mark for nothing
or for the boundary of a word, each at a price. Viterbi decoding finds the cheapest
reading under the model, and the words of the restored text are scored. What is longer
than ``WINDOW`` is decoded in windows that overlap, from its first to its last
character. The model alone parts rare words badly, so what lies between any two blanks
or marks of a restored run is looked up too, as is what two or three neighbouring
tokens, one of them short, make together: these count where they are words with a
weight.

Scoring looks a document's words, and the beginnings of its words, up in weights that
were learnt from labelled documents; a small logistic model turns the strongest
evidence into a probability. Learning uses rows with crc32(doc_id) mod 3 other than 1
alone and a bounded sample of them (``MOST_LABELLED``); labels, language, source and
id are no inputs of a score. The model, the weights and the coefficients have bounded
sizes and are all that the driver sees; texts are never shuffled.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import cut, documents

QUERY = "op2_toxicity"
ORACLE_SQL = None
#: Labelled documents of each label that learning takes, at most; the rest of the labels is not read into it.
MOST_LABELLED = 8000
#: A word or beginning is kept if it is surely so many times likelier in toxic documents: both shares are shrunk by so many standard errors, so that a small sample keeps what it shows clearly and a large one no chance finds.
LEAST_RATIO, ERRORS = 20.0, 1.0
#: A beginning needs so many different words of toxic documents, none of them with more than half of its weight: it stands for a family, not for one word.
LEAST_FAMILY = 5
#: The share of toxic documents that scores are made for.
PRIOR = 0.1
#: Predicted toxic from this score on.
THRESHOLD = 0.7
#: The letters of the model, all others being a boundary.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
#: What a written character may imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "", "&": "", ".": "", "-": "", "_": "", "~": "", "'": "", ",": "", "/": "", "\\": "", "^": "", "=": "", ":": ""}
#: Prices in nats: a letter imitated, a mark or separator that stands for nothing, a digit or letter-like sign that does, a letter repeated; a mark that parts words, a blank inside a run that stands for nothing.
IMITATED, NOTHING, LOST, REPEATED, BROKEN, JOINED = 1.0, 1.5, 7.0, 1.0, 2.0, 0.3
#: Characters that are decoded at once, and how many of them the next window repeats: whatever the length, memory is that of a window.
WINDOW, OVERLAP = 256, 64
PREFIXES = (4, 5, 6)
#: Endings that a word with a weight may have besides.
PLURALS = ("s", "es")
CACHED = 150_000
A = len(LETTERS) + 1
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_EDGE = "".join(sorted({*".,;:!?\"'()[]{}<>|*#%&$@^~=/\\-_+`¡¿«»„“”‚‘’…–—"}))
#: A run of pieces set apart, however far: three or more of one or two characters, and one of three at either end. Longer pieces are joined as tokens.
_APART = re.compile(r"(?<!\S)(?:\S{3}\s+)?\S{1,2}(?:\s+\S{1,2}(?!\S)){2,}(?:\s+\S{3}(?!\S))?")
_GAP = re.compile(r"\s+")
#: More than three of the same character in a row are three.
_MANY = re.compile(r"(.)\1{3,}", re.DOTALL)
_ROW = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1+", re.DOTALL)
#: In a reading: a blank or mark that stands for nothing.
SEAM = "\x1f"
_SEAMS = re.compile(r"[ \x1f]+")
#: Longest token or run that a task remembers; longer ones are decoded each time.
REMEMBERED = 64


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(gram int, n long) over the words of all texts: each task sums its own counts, so at most A**3 rows of a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x250, np.int64)
        for c, i in _INDEX.items():
            table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 and ord(c.upper()) < 0x250 else ord(c)] = i
        total = np.zeros(A**3, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                line = "  ".join(t for t in b.column(0).slice(at, 500).to_pylist() if t)
                x = np.frombuffer(f"  {line}  ".encode("utf-32-le", "replace"), np.uint32)
                x = np.where(x < 0x250, table[np.minimum(x, 0x24F)], 0)
                grams = (x[:-2] * A + x[1:-1]) * A + x[2:]
                total += np.bincount(grams, minlength=A**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities, A x A x A) of a letter after two others, interpolated with shorter contexts. Index 0 is a boundary."""
    rows = count_trigrams(docs).toArrow()  # at most A**3 rows
    n = np.zeros(A**3)
    n[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    n = n.reshape(A, A, A)
    n[:, 0, 0] = np.minimum(n[:, 0, 0], n[:, 0, 1:].sum(axis=1))  # runs of blanks say nothing
    three = n / np.maximum(n.sum(axis=2, keepdims=True), 1)
    two = n.sum(axis=0)
    two = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
    one = n.sum(axis=(0, 1))
    one = one / max(one.sum(), 1)
    return -np.log(0.7 * three + 0.2 * two[None] + 0.09 * one[None, None] + 0.01 / A)


def decode(token: str, cost: list) -> str:
    """The cheapest reading of a token or run: words, blanks between them, and a ``SEAM`` where a blank or mark stands for nothing. cost: nested lists of ``language_model``. Long ones are read in overlapping windows."""
    if len(token) <= WINDOW:
        return _decoded(token, cost)
    return " ".join(_decoded(token[at : at + WINDOW], cost) for at in range(0, len(token) - OVERLAP, WINDOW - OVERLAP))


def _decoded(token: str, cost: list) -> str:
    """Viterbi over states of the last two letters, 0 being a boundary; a blank is a gap as wide as the run's others, a line feed is a wider one."""
    prices: dict[tuple[int, int], float] = {(0, 0): 0.0}
    came: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for c in token:
        options = [(_INDEX[c], 0.0)] if c in _INDEX else [(_INDEX[x], IMITATED) for x in IMITATES.get(c, "")]
        if c == " ":
            nothing, boundary = JOINED, 0.0
        elif c == "\n":
            nothing, boundary = LOST, 0.0
        elif options:
            nothing, boundary = (None if c in _INDEX else LOST), None
        else:
            nothing, boundary = NOTHING, BROKEN
        new: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        seam = "" if options else SEAM

        def offer(state: tuple[int, int], price: float, before: tuple[int, int], written: str) -> None:
            if state not in new or price < new[state]:
                new[state] = price
                back[state] = before, written

        for state, price in prices.items():
            a, b = state
            for x, extra in options:
                offer((b, x), price + extra + cost[a][b][x], state, LETTERS[x - 1])
                if x == b:
                    offer(state, price + extra + REPEATED, state, "")
            if nothing is not None:
                offer(state, price + nothing, state, seam)
            if boundary is not None:
                if b:
                    offer((b, 0), price + boundary + cost[a][b][0], state, " ")
                else:  # no word to end
                    offer(state, price + boundary, state, "")
        prices = new
        came.append(back)
    state = min((price + (cost[a][b][0] if b else 0.0), (a, b)) for (a, b), price in prices.items())[1]
    out = []
    for back in reversed(came):
        state, written = back[state]
        out.append(written)
    return "".join(reversed(out)).strip(" " + SEAM)


class Known:
    """Words with a weight, to be found in restored runs whatever letters are doubled there."""

    def __init__(self, weights: dict[str, float]):
        self.words = {w for w in weights if not w.startswith("^")}
        self.keyed = set(weights)
        # how a word begins that has any of these among its keys
        plain = {w.lstrip("^") for w in weights}
        self.starts = {w[:3] for w in plain} | {(w + e)[:3] for w in plain if len(w) < 3 for e in PLURALS}
        self.forms = {_DOUBLE.sub(r"\1", w): w for w in sorted(self.words)}
        self.longest = max(map(len, self.forms), default=0)

    def within(self, reading: str) -> set[str]:
        """Words that lie between any two seams of a reading."""
        found = set()
        pieces = _SEAMS.split(reading) if self.forms else []
        for k in range(len(pieces)):
            text = ""
            for piece in pieces[k:]:
                text = _DOUBLE.sub(r"\1", text + piece)
                if len(text) > self.longest:
                    break
                if text in self.forms:
                    found.add(self.forms[text])
        return found


def restored(run: str, cost: list, known: Known) -> set[str]:
    """Words of what a token or run decodes to, and words with a weight between its seams."""
    reading = decode(run, cost)
    return {*reading.replace(SEAM, "").split(), *known.within(reading)}


def readings(token: str, cost: list, known: Known) -> list[str]:
    """Words that a token, in lower case, may be: itself without punctuation, and what it decodes to if it looks disguised."""
    bare = token.strip(_EDGE)
    if bare.isalpha() and len(bare) == len(token) and not _ROW.search(bare):
        return [bare]
    out = [bare] if bare else []
    # repeated signs at an end are punctuation; a sign in their stead may also be a letter
    if any(c in _INDEX for c in bare) and (not bare.isalpha() or _ROW.search(bare) or (token != bare and any(c in "@$|!*10+" for c in token[: len(token) - len(token.lstrip(_EDGE))] + token[len(token.rstrip(_EDGE)) :][:1]))):
        for x in {bare, token.rstrip(".,;:?!")}:
            out += [w for w in restored(_MANY.sub(r"\1\1\1", x), cost, known) if w not in out]
    return out


def set_apart(text: str) -> set[str]:
    """Runs of short pieces in a text in lower case: gaps as wide as the run's narrowest are blanks, wider ones line feeds."""
    found = set()
    for m in _APART.finditer(text):
        run = m[0]
        if sum(c in _INDEX or bool(IMITATES.get(c)) for c in run) < 4 or not any(c in _INDEX for c in run):
            continue
        least = min(map(len, _GAP.findall(run)))
        found.add(_GAP.sub(lambda g: " " if len(g[0]) == least else "\n", run))
    return found


def keys(word: str) -> list[str]:
    """What a word is looked up by: itself, itself without the ending of a plural, and its beginnings; a beginning by itself."""
    return [word, *(word[: -len(e)] for e in PLURALS if word.endswith(e)), *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def joined(tokens: list[str], known: Known) -> list[str]:
    """Keys with a weight that two or three tokens in a row make together, whatever their lengths: words, and beginnings of words that reach beyond the first token."""
    found = []
    starts, keyed, most = known.starts, known.keyed, PREFIXES[-1]
    for k, a in enumerate(tokens[:-1]):
        if (a if len(a) > 2 else a + tokens[k + 1])[:3] not in starts:
            continue
        text = a + tokens[k + 1]
        for more in tokens[k + 2 : k + 3], ():
            text_of = text + "".join(more)
            word = next((w for w in (text_of, *(text_of[: -len(e)] for e in PLURALS if text_of.endswith(e))) if w in keyed and len(w) > len(a)), None)
            if word:
                found.append(word)
            elif len(a) < most:
                found += [key for n in PREFIXES if len(a) < n <= len(text_of) and (key := "^" + text_of[:n]) in keyed]
    return found


class Reader:
    """The distinct words of texts, disguised ones restored. ``known``: words that tokens may be joined to."""

    def __init__(self, cost: list, known: dict[str, float] | None = None):
        self.cost, self.known = cost, Known(known or {})

    def words(self, text: str) -> set[str]:
        low = text.lower()
        tokens = low.split()
        found = set(joined(tokens, self.known))
        for t in set(tokens):
            found.update(readings(t, self.cost, self.known))
        for run in set_apart(low):
            found |= restored(run, self.cost, self.known)
        return found


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, fold, text) of at most ``most`` documents of each label, by hash of the id, among those that are not held out."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(17), "doc_id")
    ids = None
    for y in (0, 1):
        own = known.filter(F.col("toxic") == y).withColumn("h", order).orderBy("h", "doc_id").limit(most)
        ids = own if ids is None else ids.unionByName(own)
    # at most 2 * most rows of two numbers
    ids = cut(ids.select("doc_id", "toxic", F.pmod(F.col("h"), F.lit(2)).cast("int").alias("fold")))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def learn_weights(sample: DataFrame, cost: list, fold: int | None) -> dict[str, float]:
    """Log ratio, toxic to clean, of the share of documents that have a key; only keys that speak for toxicity. Of a fold, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(cost), (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts[y]
                own.update(reader.words(text or ""))
        toxic, clean = counts[1], counts[0]
        rows = [(k, n, 1) for k, n in toxic.items()] + [(k, n, 0) for k, n in clean.items()]
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int32())], names=["key", "n", "toxic"])

    sides = (sample if fold is None else sample.filter(F.col("fold") == fold)).select("text", "toxic")
    totals = {r.toxic: r.n for r in sides.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(1, 0), totals.get(0, 0)
    if not t:
        return {}
    counted = sides.mapInArrow(run, "key string, n long, toxic int").groupBy("key").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    counted = cut(counted)
    families = [counted.filter(F.length("key") >= k).groupBy(F.concat(F.lit("^"), F.substring("key", 1, k)).alias("key")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > 0).alias("words"), F.max("bad").alias("most")).filter((F.col("words") >= LEAST_FAMILY) & (2 * F.col("most") <= F.col("bad"))).select("key", "bad", "good") for k in PREFIXES]
    counted = functools.reduce(DataFrame.unionByName, families, counted)
    # families sum over words, so that their counts scatter more, and a beginning says less than a word
    errors = F.when(F.col("key").startswith("^"), 2 * ERRORS).otherwise(ERRORS)
    careful = counted.withColumn("ratio", (F.col("bad") - errors * F.sqrt("bad")) * (c + 2.0) / ((F.col("good") + errors * F.sqrt("good") + 1.0) * (t + 2.0)))
    # the sample is bounded, so these are too
    least = F.when(F.col("key").startswith("^"), 2 * LEAST_RATIO).otherwise(LEAST_RATIO)
    return {r.key: math.log(r.ratio) for r in careful.filter(F.col("ratio") >= least).select("key", "ratio").collect()}


def evidence(words: set[str], weights: dict[str, float]) -> tuple[float, float, float]:
    """The strongest weight, the sum of the strongest five and the number of words with a weight, on a log scale."""
    get = weights.get
    own = sorted((w for w in (max((get(k, 0.0) for k in keys(x)), default=0.0) for x in words) if w > 0), reverse=True)
    return (own[0] if own else 0.0, sum(own[:5]), math.log1p(len(own)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, intercept first, by Newton's method; classes weigh as ``PRIOR`` has it, whatever their shares in the sample. None but the intercept is negative, so that more evidence never lowers a score: what would be is left out, the worst first."""
    used = list(range(x.shape[1]))
    while True:
        b = _newton(x[:, used], y, ridge)
        if not used or b[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(k + 1 for k in used)]] = b
            return out
        del used[int(np.argmin(b[1:]))]


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (w * (p - y)) + ridge * b
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    """All that scoring needs; of bounded size."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], coefficients: list[float]):
        self.cost, self.weights, self.coefficients = cost, weights, coefficients


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Weights from one half of the sample, coefficients from the other, so that these see weights as new documents do; then weights from the whole sample."""
    cost = language_model(docs)
    table = cost.tolist()
    # bounded by ``most``; kept, as it is read several times
    sample = cut(_sample(docs, labels, most))
    half = learn_weights(sample, table, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(table, half)
        for b in batches:
            rows = [evidence(reader.words(t or ""), half) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), b.column(1)], names=["a", "b", "c", "toxic"])

    # bounded by the sample: three numbers and a label each
    seen = sample.filter("fold = 1").select("text", "toxic").mapInArrow(run, "a double, b double, c double, toxic int").toArrow()
    x = np.column_stack([seen.column(k).to_numpy() for k in ("a", "b", "c")]).astype(float).reshape(-1, 3)
    y = seen.column("toxic").to_numpy()
    x, y = x[order := np.lexsort((y, *x.T))], y[order]
    if not (y == 1).any() or not (y == 0).any():
        return Model(cost, half, [-3.0, 0.0, 1.0, 0.0])
    weights = learn_weights(sample, table, None)
    for k, w in half.items():
        weights[k] = max(w, weights.get(k, 0.0))
    return Model(cost, weights, fit_logistic(x, y).tolist())


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` to the other columns of ``docs`` (the text itself is left out): 0 to 1, higher for toxic.

    Null text is empty; empty texts get the score of no evidence. Every text is read
    from end to end, however long. The score is a function of the text and the model
    alone: repeated rows are scored each and equally, and ties stay ties. An empty
    table gives no rows; a column named ``score`` is replaced, others pass through.
    """
    kept = [c for c in docs.columns if c not in (text, "score")]
    shared = docs.sparkSession.sparkContext.broadcast((model.cost.astype(np.float32), model.weights, model.coefficients))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, weights, b = shared.value
        table, known = cost.tolist(), Known(weights)
        memo: dict[str, float] = {}
        runs: dict[str, list[float]] = {}
        get, starts = weights.get, known.starts

        def strongest(words: list[str]) -> float:
            return max((get(k, 0.0) for w in words if w[:3] in starts for k in keys(w)), default=0.0)

        def one(text: str) -> float:
            low, own = text.lower(), []
            tokens = low.split()
            for t in set(tokens):
                w = memo.get(t)
                if w is None:
                    w = strongest(readings(t, table, known))
                    if len(t) <= REMEMBERED:
                        memo[t] = w
                if w > 0:
                    own.append(w)
            own += [weights[w] for w in set(joined(tokens, known))]
            for run in set_apart(low):
                found = runs.get(run)
                if found is None:
                    found = [w for x in restored(run, table, known) if (w := strongest([x])) > 0]
                    if len(run) <= REMEMBERED:
                        runs[run] = found
                own += found
            own.sort(reverse=True)
            z = b[0] + b[1] * (own[0] if own else 0.0) + b[2] * sum(own[:5]) + b[3] * math.log1p(len(own))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        for whole in batches:
            for part in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                scores = [one(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                if len(memo) + len(runs) > CACHED:
                    memo.clear()
                    runs.clear()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept), "score double"])
    return docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"].cast("string").alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
