"""Streams give what their batch twins give on the same rows."""

import datetime
import io
import os
import time
import zipfile

import pytest
from docquery.operators import cache, conversation, telemetry
from docquery.sources import fixtures as fx
from docquery.sources.storage import state_session
from docquery.streaming import jobs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def stream_of(spark, tmp_path):
    def make(df, order, parts=3):
        """A file stream of ``df`` that comes in ``parts`` batches in order."""
        bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
        edges = [float("-inf"), *bounds, float("inf")]
        for i in range(parts):
            df.filter((F.col(order) > edges[i]) & (F.col(order) <= edges[i + 1])).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        return state_session(spark).readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    return make


def finished(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_counts(spark, stream_of):
    log = fx.requests(spark, SF)
    got = finished(jobs.live_counts(stream_of(log, "event_id")), "complete", "counts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, telemetry.request_counts(log).collect()))


def test_cache(spark, stream_of):
    log = fx.requests(spark, SF).select("event_id", "key", "asked_at").withColumn("at", F.unix_micros(F.col("asked_at").cast("timestamp")).cast("double"))
    got = finished(jobs.live_cache(stream_of(log, "at"), 86400), "append", "hits")
    want = cache.replay(log, 86400)
    assert sorted(map(tuple, got.select("event_id", "hit").collect())) == sorted(map(tuple, want.select("event_id", "hit").collect()))


def write_batches(spark, folder, batches, schema):
    """A file for each batch, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for f in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{f}", (time.time() - 1000 + 10 * k,) * 2)
    return state_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_requests_and_expired_keys(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[(1, 1, at(0)), (2, 1, at(5)), (3, 2, at(1))], [(4, 3, at(1000))], [(5, 1, at(10)), (6, 1, at(995)), (7, 1, at(1001))], [(8, 4, at(2000))], [(9, 4, at(2001))]]
    stream = write_batches(spark, str(tmp_path / "in"), batches, "event_id long, key long, asked_at timestamp")
    q = jobs.live_cache(stream, 60, "20 seconds").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    # 5 comes 990 seconds late and is dropped; 6 is in time, finds its entry run out, and 7 hits the one it made
    assert {r.event_id: r.hit for r in stream.sparkSession.table("late").collect()} == {1: False, 2: True, 3: False, 4: False, 6: False, 7: True, 8: False, 9: True, 5: None}
    assert tuple(jobs.late_rows(stream.sparkSession.table("late")).head()) == (8, 1)
    # the keys 1 to 3 have run out and hold no state; 4 does
    state = spark.read.format("statestore").option("stateVarName", "until").load(str(tmp_path / "c")).select("key.key").distinct()
    assert [r.key for r in state.collect()] == [4]


def test_a_hot_key_is_sorted_in_runs(monkeypatch):
    from pyspark.sql import Row

    monkeypatch.setattr(jobs, "_RUN", 7)
    rows = [Row(at=k * 37 % 101, event_id=k) for k in range(100)]
    assert [*jobs._in_order(iter(rows))] == sorted((r.at, r.event_id) for r in rows)


def test_memory(spark, stream_of, tmp_path):
    turns = fx.conversations(spark, SF)
    path = str(tmp_path / "out")

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    live = jobs.live_memory(stream_of(turns, "turn", 2), 3)
    assert live.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    got = jobs.remembered(spark.read.parquet(f"{path}/*"))
    want = conversation.appended(turns.limit(0), turns, 3)
    rows = lambda df: sorted(map(tuple, df.select("conv_id", "turn", "role", "text", "ts").collect()))
    assert rows(got) == rows(want)
    assert rows(conversation.evicted(got, 5)) == rows(conversation.evicted(want, 5))


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="N"><w:name w:val="Normal"/></w:style></w:styles>')
    return out.getvalue()


def test_ingest_files(spark, tmp_path):
    say = lambda t, style="N": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    row = lambda *ts: f"<w:tr>{''.join(map(cell, ts))}</w:tr>"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"# Head\n\n" + b"Some words here. " * 30 + b"\xff")
    (folder / "b.docx").write_bytes(docx(say(" Part one ", "H1") + say("Plain words of a paragraph. " * 12) + f"<w:tbl>{row('k', ' v ')}{row('1', '2')}</w:tbl><w:tbl>{row('only')}</w:tbl>"))
    (folder / "c.docx").write_bytes(b"no archive")
    (folder / "d.exe").write_bytes(b"x")
    (folder / "e.md").write_bytes(b" \n\n ")
    stream = lambda: jobs.file_stream(spark, str(folder), 2)
    store, options = str(tmp_path / "store"), {"size": 40, "overlap": 5, "least": 5}
    assert jobs.ingest_files(stream(), store, str(tmp_path / "c"), **options).awaitTermination(240)
    log = lambda: {r.filename: (r.status, r.tables_count, r.error) for r in spark.read.parquet(f"{store}/log").collect()}
    first = log()
    assert first["a.txt"] == ("completed", 0, None) and first["b.docx"] == ("completed", 1, None) and first["e.md"] == ("warning", 0, None)
    assert first["c.docx"][0] == "failed" and first["c.docx"][2].startswith("BadZipFile") and first["d.exe"] == ("failed", 0, "ValueError: Unsupported file format: .exe")
    chunks = [tuple(r) for r in spark.read.parquet(f"{store}/chunks").select("chunk_type", "content", "section").collect()]
    assert ("table", "Table: Table_2rows\n\nRow 1:\nk: 1\nv: 2\n", "Part one") in chunks and any(t == "text" and "Plain words" in c for t, c, _ in chunks)
    # the same batches anew, as after a lost checkpoint: nothing comes twice
    assert jobs.ingest_files(stream(), store, str(tmp_path / "c2"), **options).awaitTermination(240)
    assert log() == first and spark.read.parquet(f"{store}/chunks").count() == len(chunks)
    (folder / "f.txt").write_bytes(b"New words. " * 40)
    assert jobs.ingest_files(stream(), store, str(tmp_path / "c2"), **options).awaitTermination(240)
    assert log().keys() == first.keys() | {"f.txt"}


def test_ingest(spark, stream_of, tmp_path):
    files = fx.files(spark, SF).withColumn("n", F.col("document_id").cast("long"))
    q = jobs.ingest(stream_of(files, "n"), str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    assert q.awaitTermination(180)
    from docquery.operators import chunking

    want = files.select("document_id", F.posexplode(chunking.sentence_chunks(F.col("text"))).alias("chunk_index", "content"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "store")).select("document_id", "chunk_index", "content").collect())) == sorted(map(tuple, want.collect()))
