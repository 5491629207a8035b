"""Registered streaming and progress queries (H1-H8)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import chunk as ch
from ..session import read_table
from ..streaming import keyed_table as kt
from ..streaming import live_review as lr
from ..streaming import stream as sm
from . import common as cm
from . import q_detect, q_review
from .q_chunk import chunks_sql
from .registry import ORACLES, register

#: the chunks a document was cut into (B1), not the events seen so far
_TOTALS_SQL = f"""WITH {chunks_sql()}, T AS (SELECT doc_id, max(n_chunks) AS total_chunks FROM CH GROUP BY doc_id)"""
_PROGRESS_SQL = f"""{_TOTALS_SQL},
    E AS (SELECT user_id AS doc_id, count_if(event_type <> 'error') AS done, min(ts) AS start_time,
                 arg_min(CASE WHEN event_type = 'error' THEN event_id END, CASE WHEN event_type = 'error' THEN (ts, event_id) END) AS bad
          FROM events GROUP BY user_id)
    SELECT t.doc_id, CASE WHEN bad IS NOT NULL THEN 'ERROR' WHEN coalesce(done, 0) >= total_chunks THEN 'COMPLETED'
                          WHEN done > 0 THEN 'PROCESSING' ELSE 'QUEUED' END AS status,
           coalesce(done, 0) AS chunks_processed, total_chunks, start_time, 'chunk ' || CAST(bad AS VARCHAR) || ' failed' AS error
    FROM T t LEFT JOIN E e ON e.doc_id = t.doc_id"""


def _totals(spark, sf_dir):
    chunks = ch.chunk_documents(read_table(spark, sf_dir, "documents"), keep_text=False)
    return chunks.filter("chunk_idx = 0").select("doc_id", F.col("n_chunks").alias("total_chunks"))


@register("batch_progress", _PROGRESS_SQL)
def batch_progress(spark, sf_dir):
    """H2+H3: progress of every document from chunk events (sticky errors) against its number of chunks."""
    return sm.progress_status(_totals(spark, sf_dir), sm.progress_counts(read_table(spark, sf_dir, "events")))


@register("lost_documents", """
    SELECT doc_id, 'ERROR' AS status, 'lost' AS error FROM documents
    WHERE doc_id NOT IN (SELECT DISTINCT user_id FROM events)""")
def lost_documents(spark, sf_dir):
    """H5: submitted documents the progress tracker never saw."""
    return sm.lost_documents(read_table(spark, sf_dir, "documents"), sm.progress_counts(read_table(spark, sf_dir, "events")))


@register("sliding_windows", """
    WITH W AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start
               FROM events)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM W GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    """H8 (extension): hourly windows of events per type, one every half hour."""
    return sm.activity_windows(read_table(spark, sf_dir, "events"), slide="30 minutes")[0]


@register("activity_windows", """
    SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS n FROM events GROUP BY ALL""")
def activity_windows(spark, sf_dir):
    """H8 (extension): hourly tumbling windows of events per type."""
    t, _ = sm.activity_windows(read_table(spark, sf_dir, "events"))
    return t


@register("session_windows", """
    WITH E AS (SELECT user_id AS doc_id, ts,
                      CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                             OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS brk
               FROM events),
         S AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM E)
    SELECT doc_id, min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTE AS session_end, count(*) AS n_events
    FROM S GROUP BY doc_id, sid""")
def session_windows(spark, sf_dir):
    """H8 (extension): activity sessions per document with a 10-minute gap."""
    _, s = sm.activity_windows(read_table(spark, sf_dir, "events"))
    return s


def _run_dir(spark, name):
    return os.path.join(sm.checkpoint_path(spark, name), uuid.uuid4().hex)


@register("stream_detect", ORACLES["detect_patterns"])
def stream_detect(spark, sf_dir):
    """H1: the pattern detector as a Structured Streaming query over the
    documents files (availableNow trigger, file sink); equals the batch result."""
    base = _run_dir(spark, "stream_detect")
    docs = sm.read_documents_stream(spark, os.path.join(sf_dir, "documents.parquet"))
    q = (sm.detect_stream(docs).writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).select(*q_detect._HEUR_COLS)


@register("stream_progress", _PROGRESS_SQL)
def stream_progress(spark, sf_dir):
    """H2 streamed: chunk events counted per document in update mode (only changed documents are written, as a
    keyed table); the view over it equals the batch result."""
    base = _run_dir(spark, "stream_progress")
    events = sm.read_table_stream(spark, os.path.join(sf_dir, "events.parquet"), sm.EVENT_SCHEMA)
    out = os.path.join(base, "out")
    q = (sm.progress_counts(events).writeStream.outputMode("update").foreachBatch(sm.upsert_batch(out))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return sm.progress_status(_totals(spark, sf_dir), sm.read_upserts(spark, out))


@register("stream_progress_compacted", _PROGRESS_SQL)
def stream_progress_compacted(spark, sf_dir):
    """H2 over many micro-batches: the events come in ten files, one a micro-batch; the keyed table of counts is compacted on the
    way, and the view over it equals the batch result."""
    base = _run_dir(spark, "stream_progress_compacted")
    read_table(spark, sf_dir, "events").repartitionByRange(10, "event_id").write.parquet(os.path.join(base, "in"))
    events = sm.read_table_stream(spark, os.path.join(base, "in"), sm.EVENT_SCHEMA)
    out = os.path.join(base, "out")
    q = (sm.progress_counts(events).writeStream.outputMode("update").foreachBatch(kt.keyed_batch(out, every=4))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return sm.progress_status(_totals(spark, sf_dir), kt.KeyedTable(spark, out).read())


@register("stream_corrections", f"""{q_review.REPLAYED_SQL}
    SELECT doc_id, det_id, char_start, char_end, type, status, status_before_review, action_mode, custom_replacement, source FROM RPL""")
def stream_corrections(spark, sf_dir):
    """H7: the corrections log as a stream of five files, some actions sent again, applied by the stateful operator: updates, bulk
    actions, undo, adds and deletes; the table of changes over the detections equals the batch replay."""
    base = _run_dir(spark, "stream_corrections")
    dets, sessions = q_review._rd(spark, sf_dir), cm.doc_sessions(spark, sf_dir)
    log = q_review._log(spark, sf_dir, dets)
    log = log.unionByName(log.filter("seq % 7 = 3")).withColumn("event_time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq")))
    log.repartitionByRange(5, "seq").write.parquet(os.path.join(base, "in"))
    own = spark.newSession()  # the state store is chosen for this stream only
    own.conf.set("spark.sql.shuffle.partitions", str(min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    stream = own.readStream.schema(log.schema).option("maxFilesPerTrigger", "1").parquet(os.path.join(base, "in"))
    q = (lr.live_corrections(stream, dets, sessions).writeStream.outputMode("update").foreachBatch(sm.upsert_batch(os.path.join(base, "out")))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = lr.reviewed(dets, lr.read_changes(spark, os.path.join(base, "out")))
    return out.select("doc_id", "det_id", "char_start", "char_end", "type", "status", "status_before_review", "action_mode", "custom_replacement", "source")


#: the files of the event stream: four stretches of time; some events come one file late, a few two files
_LATE_SQL = """
    F AS (SELECT *, least(3, CAST(floor(4.0 * (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / greatest(1, (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events))) AS INT)) AS q
          FROM events),
    B AS (SELECT * EXCLUDE (q), least(3, q + CASE WHEN event_id % 53 = 0 THEN 2 WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS batch FROM F)"""


@register("stream_windows", f"""
    WITH {_LATE_SQL},
    M AS (SELECT k.batch, max(b.ts) AS top FROM range(4) AS k(batch) JOIN B b ON b.batch <= k.batch GROUP BY k.batch),
    W AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM B),
    K AS (SELECT w.* FROM W w LEFT JOIN M m ON m.batch = w.batch - 2
          WHERE m.top IS NULL OR window_start + INTERVAL 1 HOUR > date_trunc('millisecond', m.top) - INTERVAL 2 HOUR)
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM K
    WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM B) GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """H8 on a stream in append mode: sliding windows with a watermark of two hours.  A window comes out once, when the watermark has
    passed it; an event counts unless its window was passed by the watermark of the micro-batch before."""
    base = _run_dir(spark, "stream_windows")
    events = read_table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    place = F.floor(F.lit(4.0) * (micros - F.lit(low)) / F.lit(max(1, (high or 0) - (low or 0))))
    late = F.when(F.expr("event_id % 53 = 0"), 2).when(F.expr("event_id % 50 = 0"), 1).otherwise(0)
    dealt = events.withColumn("file", F.least(F.lit(3), F.least(F.lit(3), place.cast("int")) + late))
    for k in range(4):  # the order of the files is that of their writing
        dealt.filter(F.col("file") == k).select(*events.columns).repartition(1).write.mode("append").parquet(os.path.join(base, "in"))
    stream = sm.read_table_stream(spark, os.path.join(base, "in"), sm.EVENT_SCHEMA)
    windows, _ = sm.activity_windows(stream, watermark="2 hours", slide="30 minutes")
    q = (windows.writeStream.format("parquet").outputMode("append").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(windows.schema).parquet(os.path.join(base, "out"))
