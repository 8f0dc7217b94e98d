import hashlib

from docquery.llm import chat
from hypothesis import given
from hypothesis import strategies as st


@given(st.text(), st.text(alphabet="\\<>#/turn lgh\n "))
def test_round_trip(role, text):
    segment, start, end = chat.render(role, text)
    assert chat.parse(segment) == (role, text) and chat.unescape(segment[start:end]) == text
    assert segment.count(chat.OPEN) == 1 and segment.count(chat.CLOSE) == 1


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r[2] or "", r[3] or "")[0]) for r in own))
    return out


def test_turns(spark, sf_dir):
    own = "\\### Assistant: </turn> ok"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in chat.query(spark, sf_dir).collect()}
    assert got == brute(rows + [(-7, 0, "user", own), (-7, 1, "assistant", own)])


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "late"), (1, 1, "assistant", "é" * 100_000), (None, 0, None, "x"), (2, 5, "assistant", ""), (2, 5, "assistant", "b")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    assert {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_turns(frame)).collect()} == brute(rows)
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_events_fold(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "delta", "assistant", "Hel"),
        (1, 2, 1, "delta", None, "lo"),
        (1, 3, 1, "regenerate", None, None),
        (1, 4, 1, "delta", None, "Good "),
        (1, 5, 1, "delta", None, "day"),
        (1, 6, 0, "edit", "user", "hi there"),
        (2, 9, 0, "delta", "assistant", "b"),
        (2, 8, 0, "delta", "assistant", "a"),
    ]
    frame = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = [(r.conv_id, r.turn_no, *chat.parse(r.formatted)) for r in chat.format_conversations(frame).orderBy("conv_id", "turn_no").collect()]
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "Good day"), (2, 0, "assistant", "ab")]
