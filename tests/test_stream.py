"""Structured Streaming forms equal the batch forms (H1, H2)."""

from tests.conftest import SF_SMALL

import __spark_entry__ as entry


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_stream_detect_equals_batch(spark):
    q = entry.queries()
    assert _rows(q["stream_detect"](spark, SF_SMALL)) == _rows(q["detect_patterns"](spark, SF_SMALL))


def test_stream_progress_equals_batch(spark):
    q = entry.queries()
    assert _rows(q["stream_progress"](spark, SF_SMALL)) == _rows(q["batch_progress"](spark, SF_SMALL))


def test_handover_is_idempotent(spark):
    import tempfile
    from pyspark.sql import functions as F
    from spanveil.streaming import stream as sm
    out = tempfile.mkdtemp(prefix="spanveil-handover-") + "/store"
    prog = spark.createDataFrame([(1, "COMPLETED"), (2, "PROCESSING"), (3, "COMPLETED")], "doc_id long, status string")
    write = sm.handover_batch(out)
    write(prog, 7)
    write(prog, 7)                     # a replayed batch rewrites its own partition only
    write(prog.filter(F.col("doc_id") == 3), 8)
    got = sorted(r.doc_id for r in sm.read_upserts(spark, out).collect())
    assert got == [1, 3]               # document 3 came twice and stands once


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    """Three part files, three micro-batches, each document's state visible between them."""
    from pyspark.sql import functions as F
    from spanveil.streaming import stream as sm
    for t in ("documents", "events"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    q = entry.queries()
    for name, batch in (("stream_detect", "detect_patterns"), ("stream_progress", "batch_progress")):
        assert _rows(q[name](spark, str(tmp_path))) == _rows(q[batch](spark, SF_SMALL))
    totals = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, total_chunks int")
    event = lambda i, d, k: (i, d, k)
    seen = []
    for n in range(4):
        events = spark.createDataFrame([event(1, 1, "view"), event(2, 1, "view"), event(3, 3, "error")][:n], "event_id long, user_id long, event_type string") \
            .withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
        seen.append(tuple(r.status for r in sm.progress_status(totals, sm.progress_counts(events)).orderBy("doc_id").collect()))
    assert seen == [("QUEUED", "COMPLETED", "QUEUED"), ("PROCESSING", "COMPLETED", "QUEUED"), ("COMPLETED", "COMPLETED", "QUEUED"),
                    ("COMPLETED", "COMPLETED", "ERROR")]


def test_corrections_stream_equals_batch(spark):
    import os
    import tempfile
    from pyspark.sql import functions as F
    from spanveil.operators import review as rv
    from spanveil.streaming import stream as sm
    from tests.test_review import _mock
    root = tempfile.mkdtemp(prefix="spanveil-corr-")
    src = os.path.join(root, "in")
    dets = _mock(spark)
    sess = spark.createDataFrame([(1, "s1")], "doc_id long, session_id string")
    rows = [("s1", 1, 1, "update", "d2", "redacted", None, None, None),
            ("s1", 2, 1, "update", "d3", "dismissed", "anonymize", None, None),
            ("s1", 3, 1, "undo", None, None, None, None, None),
            ("s1", 3, 1, "undo", None, None, None, None, None),       # replayed duplicate
            ("s1", 4, 1, "bulk_accept", None, None, None, None, 0.3)]
    log = spark.createDataFrame(rows, "session_id string, seq long, doc_id long, action string, det_id string, "
                                      "status string, action_mode string, custom_replacement string, threshold double")
    for c in ("char_start", "char_end"):
        log = log.withColumn(c, F.lit(None).cast("long"))
    log = log.withColumn("text", F.lit(None).cast("string")).withColumn("type", F.lit(None).cast("string")) \
        .withColumn("event_time", F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.expr("make_interval(0,0,0,0,0,0,seq)"))
    log.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(log.schema).parquet(src)
    q = (sm.dedup_corrections(stream).writeStream
         .foreachBatch(sm.corrections_batch(os.path.join(root, "log"), os.path.join(root, "status"), dets, sess))
         .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = {r.det_id: r.status for r in spark.read.parquet(os.path.join(root, "status")).collect()}
    batch = {r.det_id: r.status for r in rv.replay(dets, log.dropDuplicates(["session_id", "seq"]).drop("event_time"),
                                                   sess).collect()}
    assert streamed == batch
    assert streamed["d3"] == "false_positive" and streamed["d2"] == "redacted"


def test_session_windows_with_a_watermark(spark, tmp_path):
    """Append mode: a session comes out once, when the watermark has passed its end, and equals the batch's."""
    from pyspark.sql import functions as F
    from spanveil.streaming import stream as sm
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    days = [r[0] for r in events.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()]
    for part in (days[:10], days[10:20], days[20:]):
        events.filter(F.to_date("ts").isin(part)).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    _, sessions = sm.activity_windows(sm.read_table_stream(spark, str(tmp_path / "in"), sm.EVENT_SCHEMA), watermark="3 hours")
    sessions.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    top = events.agg(F.max("ts")).first()[0]
    _, batch = sm.activity_windows(events)
    want = batch.filter(F.col("session_end") <= F.date_trunc("millisecond", F.lit(top)).cast("timestamp_ntz") - F.expr("INTERVAL 3 HOURS"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert _rows(got) == _rows(want) and 0 < got.count() < batch.count()
