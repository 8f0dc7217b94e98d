"""Quality rules, line first, in DataFrame functions alone.

Each line is judged by itself: punctuation and symbols, navigation bars, shouting and
boilerplate phrases. Failing lines go, repeats of a line within a text go, and a text
that loses too much of itself that way is rejected, besides the whole-text base rules
(too few words, too many words in repeated eight-word windows). Everything is a
projection of one row: no shuffle, no Python, memory bounded by one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import WORD, documents, let

QUERY = "op6_quality"
#: A text with fewer words, or with more than so many percent of its words in repeated windows of so many words, fails the base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: A text is rejected if it loses more than this percentage of the characters of its lines.
MOST_LOST = 50
#: What a line fails on. Percentages are of the line's words or, for symbols, of its characters.
SYMBOLS, BARS = "[#*$%&|<>]", r"[|\x{2022}\x{00B7}]"
NAVIGATION_BARS, MOST_SYMBOLS, MOST_SHOUTED, SHORT_LINE = 3, 10, 50, 4
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of (use|service)",
    "cookie (policy|settings)",
    "(accept|use of|uses) (all )?cookies",
    "enable javascript",
    "click here to",
    "sign in to continue",
    "subscribe to our newsletter",
    "lorem ipsum",
)


def line_passes(line: Column) -> Column:
    """Whether a line with a word passes: boolean."""
    words = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(BARS))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouted = F.regexp_count(line, F.lit("!!"))
    unfinished = ~line.rlike(r"""[.!?:;,"'\x{201D}\x{2026}\x{BB})\]0-9\x{3002}][\x20\x09-\x0D]*$""")
    return ~(
        (bars >= NAVIGATION_BARS)
        | (100 * symbols > MOST_SYMBOLS * F.length(line))
        | (100 * shouted > MOST_SHOUTED * words)
        | (unfinished & (words < SHORT_LINE))
        | F.lower(line).rlike("|".join(BOILERPLATE))
    )


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the array, as long.

    Windows are compared by 64-bit hashes of their words' hashes. Most texts have no
    repeat, which one hash set shows; for the others windows are sorted with their
    places, so the work stays n log n for very long texts.
    """
    n = F.size(words)

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
            kept = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(placed, lambda s: let(places(s), length))

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(let(hashed, of))


def judged(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_percent, base_failed, kept and clean_text to ``docs`` (text and any others).

    Lines are parts between line feeds. clean_text joins the lines that pass, each
    once, without blank ones; it is what a kept text becomes. A null text counts as
    empty: it has no words and fails. Repeated rows and ties are judged alike, each by
    itself. Columns of the names that are added are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_percent", "base_failed", "kept", "clean_text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = lambda lines: F.length(F.array_join(lines, ""))
    step = docs.drop(*made, "__lines", "__words", "__pass").withColumns({"__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    step = step.withColumn("__pass", F.array_distinct(F.filter("__lines", line_passes)))
    step = step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": joined(F.col("__words")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
            "lost_percent": F.when(F.size("__lines") > 0, 100 * (joined(F.col("__lines")) - joined(F.col("__pass"))) / joined(F.col("__lines")).cast("double")).otherwise(F.lit(0.0)),
            "clean_text": F.array_join("__pass", "\n"),
        }
    )
    step = step.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return step.withColumn("kept", ~F.col("base_failed") & (F.col("lost_percent") <= MOST_LOST)).drop("__lines", "__words", "__pass")


def clean(docs: DataFrame) -> DataFrame:
    """Kept rows of ``docs`` with their cleaned texts, and n_chars to match where there is such a column; other columns pass through, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    kinds = dict(docs.dtypes)
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(kinds.get("n_chars", "long"))}
    # a filter on a projection with a row number is not moved below it, where all rules would be evaluated once more
    kept = judged(packed).withColumn("__n", F.monotonically_increasing_id()).filter("kept and __n >= 0")
    return kept.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost_percent", 6).alias("lost_percent"))


ORACLE_SQL = (
    r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), parts AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT r, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS w,
         unnest(range(1, len(words) - 6)) AS i
  FROM parts WHERE len(words) >= 8
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
  SELECT r, CAST(sum(least(8, coalesce(next_i - i, 8))) AS BIGINT) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next_i FROM twice) GROUP BY r
), judged AS (
  SELECT p.*, coalesce(c.n, 0) AS n_repeat_words,
         list_distinct(list_filter(lines, lambda x: NOT (
           len(regexp_extract_all(x, '[|\x{2022}\x{00B7}]')) >= 3
           OR 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > 10 * length(x)
           OR 100 * len(regexp_extract_all(x, '!!')) > 50 * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
           OR (NOT regexp_matches(x, '[.!?:;,"''\x{201D}\x{2026}\x{BB})\]0-9\x{3002}][\x20\x09-\x0D]*$') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 4)
           OR regexp_matches(lower(x), '"""
    + "|".join(BOILERPLATE)
    + r"""')))) AS passed
  FROM parts p LEFT JOIN covered c USING (r)
), measured AS (
  SELECT *, len(words) AS n_words,
         CASE WHEN len(lines) > 0 THEN 100 * (length(array_to_string(lines, '')) - length(array_to_string(passed, ''))) / CAST(length(array_to_string(lines, '')) AS DOUBLE) ELSE 0.0 END AS lost
  FROM judged
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words,
       CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 50 AS kept,
       round(CAST(lost AS DOUBLE), 6) AS lost_percent
FROM measured
"""
)
