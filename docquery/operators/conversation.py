"""Conversation memory as windows over a long table of turns (conv_id, turn, role, text, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.config import DEFAULTS

#: Words and phrases that point back to an earlier turn.
ANAPHORA = ("it", "its", "they", "them", "their", "those", "these", "that", "this", "he", "she", "his", "her", "there", "which", "such", "the same", "the above", "aforementioned", "the previous", "the latter", "the former", "3 people", "2 people", "those people", "those authors", "those documents", "that policy", "that procedure")
#: The prompt of a rewrite.
REWRITE_PROMPT = "Conversation history (most recent last):\n%s\n\nFollow-up question: %s\n\nRewritten standalone question:"
#: The prompt of an answer.
SYSTEM_PROMPT = "Answer from the given context and cite its sources."
ANSWER_PROMPT = "Answer the following question based on the provided context.\n\nCONTEXT:\n%s\n\nQUESTION: %s\n\nANSWER:"


def _before(n: int | None = None) -> Window:
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def needs_rewrite(question: Column) -> Column:
    """Whether a question holds one of the words, or contains one of the phrases."""
    low = F.lower(question)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    single = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ANAPHORA if " " not in w]))
    phrase = low.rlike("|".join(w for w in ANAPHORA if " " in w))
    return F.coalesce(single | phrase, F.lit(False))


def with_history(turns: DataFrame, n: int = DEFAULTS.history_turns) -> DataFrame:
    """Adds to each turn prior_turns (their number), history (the last ``n`` before it: array of role, text) and last_user (the text of the last user turn before it). Empty turns are left out beforehand."""
    own = turns.filter("text <> ''")
    return own.withColumns(
        {
            "prior_turns": F.count("*").over(_before()),
            "history": F.collect_list(F.struct("role", "text")).over(_before(n)),
            "last_user": F.last_value(F.when(F.col("role") == "user", F.regexp_replace("text", r"^\s+|\s+$", "")), F.lit(True)).over(_before()),
        }
    )


def rewrite_gate(prior_turns: Column, question: Column, least: int = DEFAULTS.rewrite_turns) -> Column:
    return (prior_turns >= least) & needs_rewrite(question)


def history_text(history: Column, chars: int = DEFAULTS.turn_chars) -> Column:
    """``Role: text`` lines; texts are cut to ``chars``."""
    name = lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1000)))
    return F.array_join(F.transform(history, lambda h: F.concat(name(h["role"]), F.lit(": "), F.substring(h["text"], 1, chars))), "\n")


def rewrite_prompt(history: Column, question: Column) -> Column:
    return F.format_string(REWRITE_PROMPT, history_text(history), question)


def rewritten(answer: Column, question: Column) -> Column:
    """A rewritten question without blanks and quotes around it; the original where there is none."""
    plain = F.regexp_replace(F.regexp_replace(answer, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), question)


def with_context_prefix(question: Column, last_user: Column, prefix: int = DEFAULTS.prefix_chars, compare: int = DEFAULTS.compare_chars) -> Column:
    """``Context: … | Question: …`` with the last user turn, unless there is none or it begins like the question."""
    same = F.substring(F.lower(last_user), 1, compare) == F.substring(F.lower(question), 1, compare)
    usable = last_user.isNotNull() & (last_user != "") & ~same
    return F.when(usable, F.concat(F.lit("Context: "), F.substring(last_user, 1, prefix), F.lit(" | Question: "), question)).otherwise(question)


def histories(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The turns of each wanted conversation with their place in it, a row each, so that no conversation is one value; one row without a place where it is unknown."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    said = turns.join(ids.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", place.alias("place"), "role", "text")
    return ids.select("conv_id").distinct().join(said, "conv_id", "left")


def appended(turns: DataFrame, new: DataFrame, most: int = DEFAULTS.max_messages) -> DataFrame:
    """Turns and new ones, of each conversation the last ``most``."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.unionByName(new).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= most).drop("back")


def summaries(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("message_count"))


def recent(turns: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` conversations updated last."""
    return summaries(turns).orderBy(F.desc("updated_at"), "conv_id").limit(n)


def evicted(turns: DataFrame, most: int = DEFAULTS.max_conversations) -> DataFrame:
    """Turns of the ``most`` conversations updated last."""
    return turns.join(recent(turns, most).select("conv_id"), "conv_id", "left_semi")


def without(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns of conversations that are not deleted."""
    return turns.join(ids.select("conv_id"), "conv_id", "left_anti")


def stats(turns: DataFrame) -> DataFrame:
    return turns.agg(F.countDistinct("conv_id").alias("total_conversations"), F.count("*").alias("total_messages"), F.lit(DEFAULTS.max_conversations).alias("max_conversations"), F.lit(DEFAULTS.max_messages).alias("max_messages"))


def prompt_messages(history: Column, context: Column, question: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The message array of a prompt: system, the last turns, and the question with its context."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    return F.concat(F.array(message(F.lit("system"), F.lit(system))), F.transform(history, lambda h: message(h["role"], h["text"])), F.array(message(F.lit("user"), F.format_string(ANSWER_PROMPT, context, question))))
