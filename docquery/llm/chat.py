"""Chat formatting by event-sourced reconstruction.

Logs of a conversation are events with a sequence number: whole messages, streamed
deltas, edits and regenerations. They are partitioned by conversation, sorted by
sequence, folded into final messages and rendered in a template. One output row is
one rendered turn, so a conversation that holds a third of all events never becomes
one value: the segments of a conversation, in the order of ``turn_no``, are its text.

Folding streams through sorted rows and keeps one message in memory. Losing an
executor repeats only its tasks, as each reads a shuffle or a file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY = "op10_chat_format"
#: Control strings of the template, and what stands in a text for a character that could begin one.
OPEN, END, CLOSE = "<turn ", ">\n", "\n</turn>\n"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("#", "\\h"))
_BACK = {escaped: plain for plain, escaped in ESCAPES}
_SEGMENT = re.compile(r"<turn ([^<>]*)>\n([^<>]*)\n</turn>\n\Z")
_ESCAPED = re.compile(r"\\[\\lgh]")
_ROWS = 2000

EVENTS = "conv_id, seq, message, kind, role, text"
FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
READ_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    for plain, escaped in ESCAPES:
        text = text.replace(plain, escaped)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn, and where its text starts and ends in it."""
    head = f"{OPEN}{escape(role)}{END}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment: the inverse of ``render``."""
    if not (m := _SEGMENT.fullmatch(segment)):
        raise ValueError(f"not a rendered turn: {segment[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for r in rows:
        kept.append(r)
        if len(kept) == _ROWS:
            yield pa.record_batch([list(c) for c in zip(*kept, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.record_batch([list(c) for c in zip(*kept, strict=True)], schema=schema)


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Final (conversation, message, role, text) of sorted events. Pieces of deltas are joined once, so long streams stay linear."""
    at, role, pieces = None, "", []
    for conv, _, message, kind, who, text in rows:
        key = (conv, message)
        if at != key:
            if at is not None:
                yield (*at, role, "".join(pieces))
            at, role, pieces = key, "", []
        if kind in ("message", "edit", "regenerate"):
            pieces = []
        if who is not None and not (kind != "message" and role):
            role = who
        pieces.append(text or "")
    if at is not None:
        yield (*at, role, "".join(pieces))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def segments() -> Iterator[tuple]:
        conv, n = object(), 0
        for c, _, role, text in _fold(_rows(batches)):
            n = n + 1 if c == conv else 0
            conv = c
            segment, start, end = render(role, text)
            loss = role == "assistant"
            yield c, n, segment, start if loss else None, end if loss else None

    return _batches(segments(), FORMATTED)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(events: DataFrame) -> DataFrame:
    """Events (conv_id long, seq long, message long, kind, role, text) to rendered turns.

    ``kind``: ``message`` (a whole text), ``delta`` (more text), ``edit`` (replaces the
    text so far), ``regenerate`` (drops it; deltas follow). Messages are ordered by
    their number, events by ``seq``; ties by kind, role and text, nulls first, so
    reruns agree. Repeated rows are repeated events. Null text is empty, a null
    role is the empty role, null conversations are one conversation, null numbers
    come first. Each event with a null message number joins the message null.
    Returns conv_id, turn_no (from 0), formatted, and loss_start and loss_end: the
    span of an assistant's text in ``formatted`` (null for other roles).
    """
    cols = [c.strip() for c in EVENTS.split(",")]
    return _by_conversation(events.select(*cols), "message", "seq", "kind", "role", "text").mapInArrow(_format, "conv_id long, turn_no long, formatted string, loss_start long, loss_end long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def conversations() -> Iterator[tuple]:
        conv, state = object(), None
        for c, _, segment, start, end in _rows(batches):
            if c != conv:
                if state:
                    yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(segment)
            if start is not None:
                loss = unescape(segment[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
        if state:
            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    return _batches(conversations(), READ_BACK)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, parsed from rendered turns alone; a digest runs along the turns and keeps one of them in memory."""
    return _by_conversation(formatted, "turn_no").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Characters of a streamed delta.
DELTA = 200


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The log that a conversation table (conv_id, turn, role, text) is the outcome of.

    Rows are numbered as messages by turn, role and text, nulls first, so that rows of
    one turn stay messages of their own. An assistant's text is streamed in deltas; of
    every fourth one an attempt went before that was generated again. Every third
    message of the others was a draft that an edit replaced. Folding gives the rows.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(by).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    n, text = F.length("text"), F.col("text")
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / DELTA).cast("int")), lambda i: one("delta", F.substring(text, i * DELTA + 1, F.lit(DELTA))))
    again = F.concat(F.array(one("delta", F.reverse(F.substring(text, 1, DELTA))), one("regenerate", F.lit(None).cast("string"))), deltas)
    streamed = F.when(F.col("message") % 4 == 0, again).otherwise(deltas)
    edited = F.array(one("message", F.substring(text, 1, DELTA)), one("edit", text))
    steps = F.when(F.col("role") == "assistant", streamed).when(F.col("message") % 3 == 0, edited).otherwise(F.array(one("message", text)))
    return rows.select("conv_id", "message", "role", F.posexplode(steps).alias("step", "e")).select("conv_id", F.col("step").cast("long").alias("seq"), "message", "e.kind", "role", "e.text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``format_conversations`` of the events of a table with one row a turn (conv_id, turn, role, text): equal turn numbers stay separate turns."""
    return format_conversations(conversation_events(conversations))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts look like control strings and escapes."""
    own = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(rows))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<>#]', '', 'g')) AS body FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + length(role) + 2 + body + 9) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
