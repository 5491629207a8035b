"""Structured Streaming forms of the batch operators (H1-H8).

The detection operators are stateless per document, so the same functions
run on a streaming DataFrame.  Progress is a streaming aggregation keyed by
document; hand-over and live corrections use ``foreachBatch`` with writes
that are idempotent per batch id (dynamic partition overwrite), so a
restarted query that replays a batch produces the same tables.
Checkpoints go to the shared folder the session names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as dt
from ..operators import review as rv
from ..session import ensure_checkpoint_dir, share_package

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def read_table_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 1) -> DataFrame:
    """H1 + H6: the parquet files of a table, a folder of part files (new ones may arrive) or a single file;
    ``maxFilesPerTrigger`` bounds each micro-batch (the back-pressure of a
    bounded queue)."""
    share_package(spark)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger))
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isFile():
        # a stream reads folders: the folder of the file, with nothing but it
        return reader.option("pathGlobFilter", file.getName()).parquet(file.getParent().toString())
    return reader.parquet(path)


def read_documents_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    return read_table_stream(spark, path, DOC_SCHEMA, max_files_per_trigger)


def detect_stream(docs: DataFrame) -> DataFrame:
    """H1: continuous pattern detection: the batch operator on a stream."""
    h = dt.heuristic_detections(docs.select("doc_id", "text"))
    return dt.with_det_id(h).drop("h_rank")


def progress_counts(events: DataFrame) -> DataFrame:
    """H2: per document the chunks processed (failed chunks never count), the first event time and the first
    error.  An aggregation with bounded state per document; works on streams."""
    is_err = F.col("event_type") == "error"
    return events.groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count_if(~is_err).alias("chunks_processed"), F.min("ts").alias("start_time"),
        F.min(F.when(is_err, F.struct("ts", "event_id"))).alias("first_error"))


def progress_status(totals: DataFrame, counts: DataFrame) -> DataFrame:
    """H2 + H3: the light view of every document in ``totals`` (doc_id, total_chunks: how many chunks it was
    cut into).  ERROR is sticky; COMPLETED when all chunks are processed (a document without
    chunks at once); PROCESSING once one is; QUEUED before."""
    j = totals.join(counts, "doc_id", "left").withColumn("chunks_processed", F.coalesce("chunks_processed", F.lit(0)))
    err = F.when(F.col("first_error").isNotNull(),
                 F.concat(F.lit("chunk "), F.col("first_error.event_id").cast("string"), F.lit(" failed")))
    status = (F.when(err.isNotNull(), F.lit("ERROR"))
              .when(F.col("chunks_processed") >= F.col("total_chunks"), F.lit("COMPLETED"))
              .when(F.col("chunks_processed") > 0, F.lit("PROCESSING")).otherwise(F.lit("QUEUED")))
    return j.select("doc_id", status.alias("status"), "chunks_processed", "total_chunks", "start_time", err.alias("error"))


def lost_documents(submitted: DataFrame, progress: DataFrame) -> DataFrame:
    """H5: documents the client submitted that the tracker does not know are ERROR."""
    return submitted.select("doc_id").join(progress.select("doc_id"), "doc_id", "left_anti") \
        .withColumn("status", F.lit("ERROR")).withColumn("error", F.lit("lost"))


def activity_windows(events: DataFrame, size: str = "1 hour", gap: str = "10 minutes",
                     watermark: str | None = None, slide: str | None = None) -> tuple[DataFrame, DataFrame]:
    """H8 (extension): tumbling-window counts per event type (sliding ones with ``slide``) and session
    windows per document; with ``watermark`` for streams.  A watermark needs an instant, so a time without zone is taken
    in the session's zone; windows come out in the type of ``ts``."""
    kind = events.schema["ts"].dataType
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = ev.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"),
                           "event_type", "n")
    sess = ev.groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_events"))
    sess = sess.select("doc_id", F.col("w.start").cast(kind).alias("session_start"), F.col("w.end").cast(kind).alias("session_end"), "n_events")
    return counts, sess


def upsert_batch(path: str):
    """foreachBatch writer of a keyed table: each micro-batch adds its rows as one partition, overwritten
    when the batch is replayed (idempotent).  ``read_upserts`` takes the last row of each key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def read_upserts(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per key, of its last batch: a row that came again stands once."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch_id").alias("_r"))
    return last.select(key, "_r.*").drop("batch_id")


def handover_batch(path: str):
    """H4: foreachBatch writer: completed documents move to the permanent store (read it with
    ``read_upserts``: each document stands once, replayed or repeated)."""
    write = upsert_batch(path)
    return lambda batch, batch_id: write(batch.filter(F.col("status") == "COMPLETED"), batch_id)


def corrections_batch(log_path: str, status_path: str, dets: DataFrame, doc_sessions: DataFrame, buckets: int = 64):
    """H7: foreachBatch for a corrections stream: append the batch to the log
    (partitioned by session bucket and batch id, idempotent), then replay the buckets the
    batch touched, reading only their part of the log, and overwrite their status partitions."""
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", bucket).persist()
        try:
            (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(log_path))
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        finally:
            batch.unpersist()
        log = spark.read.parquet(log_path).filter(F.col("bucket").isin(touched)).drop("batch_id", "bucket")
        mine = doc_sessions.withColumn("bucket", bucket).filter(F.col("bucket").isin(touched)).drop("bucket")
        out = rv.replay(dets.join(mine, "doc_id", "left_semi"), log, mine)
        (out.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(status_path))
    return write


def dedup_corrections(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """H7: exactly-once input: drop replayed actions within the watermark."""
    return stream.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["session_id", "seq"])
