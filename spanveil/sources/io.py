"""Sources and sinks.

Files are read with Spark's ``binaryFile`` source (one row per file, bytes
kept for export), decoded with built-in UTF-8 functions, and written back
with partitioned DataFrame writers.  Document tables used by several joins
can be stored bucketed by ``doc_id`` so later joins on doc_id do not shuffle
the text.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import small

SUPPORTED = ("txt", "pdf", "docx", "csv")
_NAMES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in SUPPORTED) + "}"


def decode_utf8(content: Column) -> Column:
    """A1: bytes to text, dropping invalid byte sequences (like Python's
    ``errors='ignore'``).  Invalid bytes become U+FFFD first and are then
    removed; a genuine U+FFFD in the source is removed as well."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def file_type(name: Column) -> Column:
    """A4: suffix to pdf/docx/csv, anything else is txt (case-insensitive)."""
    low = F.lower(name)
    return (F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx")
            .when(low.endswith(".csv"), "csv").otherwise("txt"))


def read_files(spark: SparkSession, path: str, recursive: bool = True, max_files_per_trigger: int | None = None,
               stream: bool = False) -> DataFrame:
    """A2 + A8: every .txt .pdf .docx .csv file under ``path`` (any case),
    unreadable files skipped; raw bytes kept in ``content``.

    Returns path, filename, file_type, length, content, text.  PDF and DOCX
    text extraction needs binary codecs that are not part of this engine;
    their ``text`` is the decoded bytes (A6 fallback) and ``parsed`` is false.
    """
    reader = spark.readStream if stream else spark.read
    # the name filter is the source's own, so that other files are never read
    r = reader.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()) \
        .option("ignoreCorruptFiles", "true").option("pathGlobFilter", _NAMES)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if stream:
        r = r.schema("path string, modificationTime timestamp, length long, content binary")
    df = r.load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ftype = file_type(name)
    text = decode_utf8(F.col("content"))
    return df.select("path", name.alias("filename"), ftype.alias("file_type"), "length", "content",
                     text.alias("text"), ftype.isin("txt", "csv").alias("parsed"))


def flatten_cells(cells: Column) -> Column:
    """A3: trim every cell, drop empty cells, join with ' | '."""
    trimmed = F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(trimmed, lambda c: c != ""), " | ")


def flatten_csv(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A3: ``df`` with the CSV text of ``text_col`` flattened: every record's cells trimmed, empty ones dropped, joined
    with ' | '; records joined by newline.  Quoted cells may hold commas, doubled quotes and line
    breaks (which vanish); cells may be of any length."""
    names, at = df.columns, df.columns.index(text_col)

    def flat(text: str) -> str:
        return "\n".join(" | ".join(c.strip() for c in row if c.strip()) for row in csv.reader(text.splitlines()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in small(batches):
            text = pa.array([None if t is None else flat(t) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], names=names)
    return df.mapInArrow(run, df.schema)


def doc_records(docs: DataFrame, default_mode: str = "redact", default_policy: str = "mixed_general") -> DataFrame:
    """A5: document record with char_count = length of the extracted text."""
    return docs.select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"), F.lit("ready").alias("status"),
        F.length("text").cast("bigint").alias("char_count"), F.lit(default_mode).alias("default_action_mode"),
        F.lit(default_policy).alias("policy"))


def latest_per_key(*snapshots: DataFrame, key: str | list[str]) -> DataFrame:
    """Reload merges snapshots by key: of each key all rows of the last snapshot that has it.

    With key ``doc_id`` a document's detections are those of its newest snapshot; what that one
    deleted does not come back.  The snapshot to win is given last.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tagged = None
    for i, s in enumerate(snapshots):
        t = s.withColumn("_snap", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    last = Window.partitionBy(*keys)
    return tagged.withColumn("_last", F.max("_snap").over(last)).filter("_snap = _last").drop("_snap", "_last")


def export_manifest(records: DataFrame, processed: DataFrame) -> DataFrame:
    """One output file per document: prefix anonymized_ or redacted_
    (the 'originals' export keeps the redacted_ prefix)."""
    j = records.join(processed, "doc_id", "left")
    prefix = F.when(F.col("default_action_mode") == "anonymize", "anonymized_").otherwise("redacted_")
    return j.select("doc_id", F.col("default_action_mode").alias("export_mode"),
                    F.concat(prefix, F.col("filename")).alias("out_name"),
                    F.coalesce("processed", F.lit(True)).alias("processed"))


def export_selection(docs: DataFrame, dets: DataFrame) -> DataFrame:
    """A10: processed = no detection of the document is missed (true when
    it has none)."""
    p = dets.groupBy("doc_id").agg(F.bool_and(F.col("status") != "missed").alias("processed"))
    return docs.select("doc_id").join(p, "doc_id", "left").select(
        "doc_id", F.coalesce("processed", F.lit(True)).alias("processed"))


def export_files(redacted: DataFrame, manifest: DataFrame | None = None, originals: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, export_mode, out_name, text, error: one row per selected document (``manifest``; without
    it, ``redacted`` are the rows of the manifest with their texts).  With
    ``originals`` the unchanged texts of ``docs`` are exported under the same names.  A document without
    text gets an error row and no text (F12)."""
    j = (docs if originals else redacted).select("doc_id", "text") if manifest is not None else redacted
    j = j if manifest is None else manifest.join(j, "doc_id", "left")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return j.select("doc_id", "export_mode", "out_name", F.when(~empty, F.col("text")).alias("text"),
                    F.when(empty, F.lit("Original document not found in session memory.")).alias("error"))


def write_export(files: DataFrame, path: str) -> None:
    """A9 sink: the texts of ``export_files`` partitioned by export mode; rows with an error are left out, the others are written."""
    files.filter("error IS NULL").select("export_mode", "out_name", "text").write.mode("overwrite").partitionBy("export_mode").parquet(path)


def write_bucketed(docs: DataFrame, table: str, buckets: int, key: str = "doc_id") -> None:
    """Store a document table bucketed and sorted by doc_id, so joins on
    doc_id with other bucketed tables read co-located buckets without a
    shuffle of the text."""
    docs.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
