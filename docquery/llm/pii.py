"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame functions alone.

Generators of high recall propose spans, which may overlap: the base patterns, and
wider ones for addresses written around filters, numbers without a country code and
numbers that stand beside others. Spans of the base patterns that pass the base checks
stay as they are. Every other candidate is scored by small boosted trees over features
of its form and its context, and is taken if its score reaches its kind's threshold.

The trees are fitted on the whole input. What the base checks say of a base candidate
labels it, and labels also a copy of it that is written the way a wider generator finds
it (an address around a filter, a number without its country code, other separators):
so the wide forms that the trees decide on are in training with known truth, numbers
of other kinds in the form of a telephone number among them. Candidates are counted by
feature values in Spark, and the driver sees that table of counts, whose size is
bounded by the number of combinations (``MOST_CELLS``), never the candidates. A
quarter of the documents, by hash, is left out of fitting and sets the thresholds.
Fitted trees are applied as a column expression; no row runs Python and texts are not
shuffled. Work grows with the length of a text and the number of its candidates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import cut, documents, let, scan

QUERY = "op5_pii"
ORACLE_SQL = None
KINDS = ("email", "ip", "card", "phone")
#: Boosting rounds, learning rate; precision that a kind's threshold has to reach among left-out candidates, and the score it needs at least.
ROUNDS, RATE, PRECISION, LEAST_SCORE = 24, 0.4, 0.95, 0.9

# The base patterns, written so that a matcher neither backtracks nor recurses on very long runs; they match what the plain ones do.
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wider generators.
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}}|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?|(?<![0-9+]))(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Words that announce each kind.
CUES = {"email": "e-?mail|contact|write to|reach", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax"}
#: Features of a candidate and how many values each has.
FEATURES = {"kind": 4, "wide": 2, "before": 3, "after": 3, "digits": 5, "valid": 2, "cue": 2, "marks": 3}
MOST_CELLS = math.prod(FEATURES.values()) * 4

_MATCH = "struct<s:int,e:int,m:string,l:string,r:string>"
_NONE = f"cast(array() as array<{_MATCH}>)"


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost first, without overlap: array of (s, e: code points, end exclusive; m: the match; l, r: 24 characters before and one after, up to the next match)."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(parts: Column, found: Column) -> Column:
        rows = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("p"), found.alias("m"), F.slice(parts, F.lit(2), F.size(found)).alias("q"))
        start = lambda pos, x: pos + F.length(x["p"])
        one = lambda pos, x: F.struct(start(pos, x).alias("s"), (start(pos, x) + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.substring(x["p"], -24, 24).alias("l"), F.substring(x["q"], 1, 1).alias("r"))
        return scan(rows, F.lit(0), lambda pos, x: start(pos, x) + F.length(x["m"]), one, _MATCH)

    return F.when(text.rlike(pattern), let(found, lambda f: let(parts, lambda p: placed(p, f)))).otherwise(F.expr(_NONE))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass Luhn's check."""
    doubled = lambda c, i: F.when(i % 2 == 1, 2 * c - F.when(c > 4, 9).otherwise(0)).otherwise(c)
    values = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def checked(kind: str, match: Column) -> Column:
    """The base check of a kind."""
    n = F.length(digits(match))
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(n.between(12, 19), luhn(digits(match))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def plausible(kind: str, match: Column) -> Column:
    """A looser check, for the wider candidates too: a feature, not a verdict."""
    return {
        "email": match.rlike(r"(?i)(?:\.|dot[\])}]\x20?|\.\x20?)[A-Za-z]{2,12}$"),
        "ip": F.regexp_replace(match, r"[^0-9]+", ".").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(F.length(digits(match)).between(12, 19), luhn(digits(match))).otherwise(False),
        "phone": F.length(digits(match)).between(9, 15) & ~match.rlike(r"\([01]"),
    }[kind]


def _edge(c: Column) -> Column:
    return F.when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(0)


def rewritten(kind: str, match: Column) -> Column:
    """A base match as a wider generator would find it; null where it has no such form."""
    d = digits(match)
    return {
        "email": F.regexp_replace(match, "@", " (at) "),
        "ip": F.regexp_replace(match, "[.]", "[.]"),
        "card": F.when(F.length(d) == 16, F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1.")),
        "phone": F.when(F.length(d) >= 10, F.regexp_replace(F.right(d, F.lit(10)), "^(...)(...)(....)$", "$1-$2-$3")),
    }[kind]


def _described(x: Column, kind: str, match: Column, wide: bool, base: Column, planted: bool) -> Column:
    n = F.length(digits(match))
    marks = F.length(F.regexp_replace(match, "[A-Za-z0-9]", ""))
    return F.struct(
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.lit(KINDS.index(kind)).alias("kind"),
        F.lit(int(wide)).alias("wide"),
        _edge(F.right(x["l"], F.lit(1))).alias("before"),
        _edge(x["r"]).alias("after"),
        F.when(n < 9, 0).when(n < 12, 1).when(n < 16, 2).when(n < 20, 3).otherwise(4).alias("digits"),
        F.coalesce(plausible(kind, match), F.lit(False)).cast("int").alias("valid"),
        F.lower(x["l"]).rlike(CUES[kind]).cast("int").alias("cue"),
        F.when(marks == 0, 0).when(marks < 6, 1).otherwise(2).alias("marks"),
        F.coalesce(base, F.lit(False)).alias("base"),
        F.lit(planted).alias("planted"),
    )


def _candidates(text: Column, kind: str, wide: bool) -> Column:
    if wide:
        return F.transform(matches(text, WIDER[kind]), lambda x: _described(x, kind, x["m"], True, F.lit(False), False))

    def own(ms: Column) -> Column:
        parts = [F.transform(ms, lambda x: _described(x, kind, x["m"], False, checked(kind, x["m"]), False))]
        copies = F.filter(ms, lambda x: rewritten(kind, x["m"]).isNotNull())
        parts.append(F.transform(copies, lambda x: _described(x, kind, rewritten(kind, x["m"]), True, checked(kind, x["m"]), True)))
        if kind == "card":  # numbers of another kind, in the form of a telephone number
            others = F.filter(ms, lambda x: (F.length(digits(x["m"])) >= 12) & ~x["l"].endswith("+"))
            parts.append(F.transform(others, lambda x: _described(x, "phone", rewritten("phone", x["m"]), True, F.lit(False), True)))
        return F.concat(*parts)

    return let(matches(text, BASE[kind]), own)


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``__candidates``: every proposed span of the whole text with its features and whether it passes the base check, and the rewritten copies that only training sees; null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    numbers, marks = text.rlike("[0-9]"), text.rlike(r"@|[({\[]at[)}\]]")
    none = F.filter(_candidates(F.lit(""), "ip", True), lambda x: F.lit(False))
    there = lambda when, kind: F.when(when, F.concat(_candidates(text, kind, False), _candidates(text, kind, True))).otherwise(none)
    return docs.withColumn("__candidates", F.concat(there(marks, "email"), *(there(numbers, k) for k in KINDS[1:])))


def cells(found: DataFrame) -> DataFrame:
    """Candidates of the base generators and their copies counted by feature values, by verdict and by whether their document (a hash of ``__fold``) is left out: at most ``MOST_CELLS`` rows."""
    one = found.select("__fold", F.explode("__candidates").alias("c")).filter("c.wide = 0 or c.planted")
    return one.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.base").alias("base"), (F.pmod(F.xxhash64("__fold"), F.lit(4)) == 0).alias("left_out")).agg(F.count("*").alias("n"))


class Trees:
    """Boosted trees of depth two over small whole-number features, and a threshold for each kind."""

    def __init__(self, bias: float, trees: list[tuple], thresholds: list[float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = {f: k for k, f in enumerate(FEATURES)}
        out = np.full(len(x), self.bias)
        for f, cut_, left, right in self.trees:
            for mask, (g, c, a, b) in ((x[:, at[f]] <= cut_, left), (x[:, at[f]] > cut_, right)):
                out[mask] += np.where(x[mask, at[g]] <= c, a, b)
        return out

    def score(self, c: Column) -> Column:
        """The score of a candidate, 0 to 1, as a column."""
        leaf = lambda t: F.when(c[t[0]] <= t[1], t[2]).otherwise(t[3])
        total = F.lit(self.bias)
        for f, cut_, left, right in self.trees:
            total = total + F.when(c[f] <= cut_, leaf(left)).otherwise(leaf(right))
        return 1 / (1 + F.exp(-total))

    def taken(self, c: Column) -> Column:
        limit = F.lit(2.0)
        for k, t in enumerate(self.thresholds):
            limit = F.when(c["kind"] == k, t).otherwise(limit)
        return self.score(c) >= limit


def fit(rows: list[tuple], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Trees from ``cells`` as tuples (features, base, left_out, n): Newton boosting on weighted cells. Without candidates nothing is taken."""
    table = np.array([[*map(int, r)] for r in rows], float).reshape(-1, len(FEATURES) + 3)
    x, y, out, n = table[:, : len(FEATURES)], table[:, -3], table[:, -2] == 1, table[:, -1]
    names, w = list(FEATURES), n * ~out
    if not w.sum():
        return Trees(-9.0, [], [2.0] * len(KINDS))
    model = Trees(float(np.log((w @ y + 1) / (w @ (1 - y) + 1))), [], [])

    def leaf(mask, g, h):
        return float(-rate * g[mask].sum() / (h[mask].sum() + 1.0))

    def gain(mask, g, h):
        return g[mask].sum() ** 2 / (h[mask].sum() + 1.0)

    def stump(mask, g, h):
        splits = [(gain(mask & (x[:, k] <= c), g, h) + gain(mask & (x[:, k] > c), g, h), k, c) for k, f in enumerate(names) for c in range(FEATURES[f] - 1)]
        _, k, c = max(splits)
        return names[k], c, leaf(mask & (x[:, k] <= c), g, h), leaf(mask & (x[:, k] > c), g, h)

    everything = np.ones(len(x), bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.margin(x)))
        g, h = w * (p - y), w * p * (1 - p)
        f, c, _, _ = stump(everything, g, h)
        k = names.index(f)
        model.trees.append((f, c, stump(x[:, k] <= c, g, h), stump(x[:, k] > c, g, h)))
    p = 1 / (1 + np.exp(-model.margin(x)))
    for kind in range(len(KINDS)):
        own = out & (x[:, 0] == kind) & (x[:, 1] == 1)  # thresholds decide on wide forms alone
        limit = 2.0
        for t in sorted(set(p[own]), reverse=True):
            above = own & (p >= t)
            if n[above] @ y[above] < PRECISION * n[above].sum():
                break
            limit = t
        # a left-out positive is needed to open a kind; rounding leaves no candidate just below its own score
        model.thresholds.append(max(LEAST_SCORE, float(limit) - 1e-9))
    return model


def trained(found: DataFrame) -> Trees:
    return fit([tuple(r) for r in cells(found).collect()])


def spans(model: Trees, candidates: Column) -> tuple[Column, Column]:
    """Base spans and all spans as arrays of (s, kind, e), sorted. Added spans overlap no base span; of added ones that overlap each other the first stays."""
    plain = lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))
    real = F.filter(candidates, lambda c: ~c["planted"])
    base = F.sort_array(F.transform(F.filter(real, lambda c: c["base"]), plain))
    rest = F.filter(real, lambda c: ~c["base"] & F.when(c["wide"] == 1, model.taken(c)).otherwise(False))

    def added(b: Column) -> Column:
        # both in one order; a base span goes before a candidate that begins with it
        tagged = lambda xs, own: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["e"].alias("e")))
        ordered = F.sort_array(F.concat(tagged(b, 0), tagged(F.transform(rest, plain), 1)))
        # forwards: where base spans before a candidate end; backwards: where the next base span begins
        ends = lambda xs: scan(xs, F.lit(0), lambda end, x: F.when(x["own"] == 0, F.greatest(end, x["e"])).otherwise(end), lambda end, x: end, "int")
        begins = lambda xs: F.reverse(scan(F.reverse(xs), F.lit(2147483647), lambda at, x: F.when(x["own"] == 0, x["s"]).otherwise(at), lambda at, x: at, "int"))
        free = lambda xs: F.filter(F.arrays_zip(xs.alias("x"), ends(xs).alias("end"), begins(xs).alias("begin")), lambda z: (z["x"]["own"] == 1) & (z["x"]["s"] >= z["end"]) & (z["x"]["e"] <= z["begin"]))
        alone = let(ordered, free)
        keeps = scan(alone, F.lit(0), lambda end, z: F.when(z["x"]["s"] >= end, z["x"]["e"]).otherwise(end), lambda end, z: F.struct(z["x"]["s"].alias("s"), z["x"]["kind"].alias("kind"), z["x"]["e"].alias("e"), (z["x"]["s"] >= end).alias("kept")), "struct<s:int,kind:int,e:int,kept:boolean>")
        return F.transform(F.filter(keeps, lambda x: x["kept"]), plain)

    return base, F.when(F.size(rest) == 0, base).otherwise(let(base, lambda b: F.sort_array(F.concat(b, added(b)))))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256 and spans.

    The counts are of base spans; n_added counts what the trees add. A null text is
    empty and has no spans. Texts are read from end to end, however long and however
    many spans they hold. Repeated rows are scanned each, with equal results, and spans
    that begin together are ordered by kind; null ids pass. An empty table gives no
    rows. Other columns are not read.
    """
    found = with_candidates(docs.select("doc_id", "text")).select("doc_id", F.col("doc_id").alias("__fold"), "__candidates")
    found = cut(found)
    base, whole = spans(trained(found), F.col("__candidates"))
    both = found.select("doc_id", base.alias("base"), whole.alias("whole"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return both.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], (F.size("whole") - F.size("base")).cast("long").alias("n_added"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("whole")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and n_chars to match where there is such a column; other columns pass through, whatever their names. Texts are scanned once: rows are kept with their candidates while the trees are fitted."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text", F.col("doc_id").alias("__fold"))
    found = cut(with_candidates(packed).drop("text")).withColumn("text", F.col("__row.text"))
    _, whole = spans(trained(found), F.col("__candidates"))

    def replaced(s: Column) -> Column:
        # spans of different kinds may overlap: each goes on where the ones before it end
        tag = lambda k: F.element_at(F.array(*[F.lit(f"[{name.upper()}]") for name in KINDS]), k + 1)
        piece = lambda end, x: F.concat(F.substring(F.col("text"), end + 1, F.greatest(x["s"] - end, F.lit(0))), tag(x["kind"]))
        pieces = scan(s, F.lit(0), lambda end, x: F.greatest(end, x["e"]), piece, "string")
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.array_max(F.transform(s, lambda x: x["e"])) + 1, F.length("text")))

    text = let(whole, lambda s: F.when(F.size(s) > 0, replaced(s)).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)
    clean = found.withColumn("__clean", text)
    new = {"text": F.col("__clean"), "n_chars": F.coalesce(F.length("__clean"), F.col("__row")["n_chars"]).cast(kinds["n_chars"]) if "n_chars" in kinds else None}
    return clean.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir, "doc_id", "text"))
