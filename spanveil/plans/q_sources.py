"""Registered source/sink queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import redact as rd
from ..operators import reports as rp
from ..session import cut_lineage, ensure_checkpoint_dir, read_table
from ..sources import io
from ..sources import named_files as nf
from . import common as cm
from . import sqlkit as sk
from .q_reports import _RV
from .q_review import REPLAYED_SQL, replayed
from .registry import register


@register("csv_flatten", """
    SELECT n_nationkey AS row_id,
           array_to_string(list_filter([trim(CAST(n_nationkey AS VARCHAR)), trim(n_name), trim(CAST(n_regionkey AS VARCHAR))],
                                       lambda c: c <> ''), ' | ') AS line
    FROM nation""")
def csv_flatten(spark, sf_dir):
    """A3: table rows flattened like CSV cells: trimmed, empty cells dropped, ' | ' joined."""
    n = read_table(spark, sf_dir, "nation")
    cells = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string"))
    return n.select(F.col("n_nationkey").alias("row_id"), io.flatten_cells(cells).alias("line"))


@register("file_type", """
    SELECT page_id, regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) AS filename,
           CASE WHEN lower(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1)) LIKE '%.pdf' THEN 'pdf'
                WHEN lower(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1)) LIKE '%.docx' THEN 'docx'
                WHEN lower(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1)) LIKE '%.csv' THEN 'csv' ELSE 'txt' END AS file_type
    FROM pages""")
def file_type(spark, sf_dir):
    """A4: file type from the name suffix (names from the page URLs)."""
    p = read_table(spark, sf_dir, "pages")
    name = F.regexp_extract("url", r"/([^/?#]*)([?#].*)?$", 1)
    return p.select("page_id", name.alias("filename"), io.file_type(name).alias("file_type"))


@register("doc_records", """
    SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, 'txt' AS file_type, 'ready' AS status,
           CAST(length(text) AS BIGINT) AS char_count, 'redact' AS default_action_mode, 'mixed_general' AS policy
    FROM documents""")
def doc_records(spark, sf_dir):
    """A5: document records with defaults."""
    return io.doc_records(read_table(spark, sf_dir, "documents"))


@register("state_merge", f"""{_RV},
    SNAP AS (SELECT det_id, doc_id, status, 0 AS snap FROM RD UNION ALL SELECT det_id, doc_id, status, 1 FROM RV)
    SELECT det_id, doc_id, status FROM SNAP QUALIFY snap = max(snap) OVER (PARTITION BY doc_id)""")
def state_merge(spark, sf_dir):
    """Reload merges the stored snapshot with the newer one by document; new wins."""
    old = cm.with_review_status(cm.detections(spark, sf_dir)).select("det_id", "doc_id", "status")
    new = cm.reviewed_detections(spark, sf_dir).select("det_id", "doc_id", "status")
    return io.latest_per_key(old, new, key="doc_id")


def _modes_records(spark, sf_dir):
    rec = io.doc_records(read_table(spark, sf_dir, "documents"))
    mode = F.when(F.pmod("doc_id", F.lit(3)) == 1, F.lit("anonymize")).otherwise(F.lit("redact"))
    return rec.withColumn("default_action_mode", mode)


@register("export_selection", f"""{_RV}
    SELECT d.doc_id, coalesce(p.processed, true) AS processed FROM documents d
    LEFT JOIN (SELECT doc_id, bool_and(status <> 'missed') AS processed FROM RV GROUP BY doc_id) p ON p.doc_id = d.doc_id""")
def export_selection(spark, sf_dir):
    """A10: processed-only selection (vacuously true without detections)."""
    return io.export_selection(read_table(spark, sf_dir, "documents"), cm.reviewed_detections(spark, sf_dir))


@register("export_manifest", f"""{_RV}
    SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 1 THEN 'anonymize' ELSE 'redact' END AS export_mode,
           CASE WHEN d.doc_id % 3 = 1 THEN 'anonymized_' ELSE 'redacted_' END || 'doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS out_name,
           coalesce(p.processed, true) AS processed
    FROM documents d
    LEFT JOIN (SELECT doc_id, bool_and(status <> 'missed') AS processed FROM RV GROUP BY doc_id) p ON p.doc_id = d.doc_id""")
def export_manifest(spark, sf_dir):
    """Bulk export manifest: one named output per document with its mode."""
    sel = io.export_selection(read_table(spark, sf_dir, "documents"), cm.reviewed_detections(spark, sf_dir))
    return io.export_manifest(_modes_records(spark, sf_dir), sel)


@register("doc_with_detections", f"""{_RV}
    SELECT d.doc_id, count(r.det_id) AS n_detections,
           coalesce(list(r.det_id ORDER BY r.char_start, r.det_id) FILTER (WHERE r.det_id IS NOT NULL), []) AS det_ids
    FROM documents d LEFT JOIN RV r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def doc_with_detections(spark, sf_dir):
    """Every document with its detections (ids in start order)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    d = cm.reviewed_detections(spark, sf_dir)
    g = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("char_start", "det_id"))).alias("a"))
    j = docs.join(g, "doc_id", "left")
    return j.select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_detections"),
                    F.coalesce(F.transform("a", lambda x: x["det_id"]), F.array().cast("array<string>")).alias("det_ids"))


@register("decode_text", """
    SELECT page_id, html AS text, CAST(length(html) AS BIGINT) AS n_chars FROM pages""")
def decode_text(spark, sf_dir):
    """Stored bytes (here with bytes mixed in that are not UTF-8) decoded to text; the bytes stay as they are."""
    raw = read_table(spark, sf_dir, "pages").select("page_id", F.concat(F.unhex(F.lit("FF")), F.col("html").cast("binary"),
                                                                        F.unhex(F.lit("C3"))).alias("content"))
    text = io.decode_utf8(F.col("content"))
    return raw.select("page_id", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


_EXPORT_MODE_SQL = "CASE WHEN doc_id % 3 = 1 THEN 'anonymize' ELSE 'redact' END"


@register("reviewed_export", f"""{REPLAYED_SQL},
    OPEN AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM RPL WHERE status = 'missed')),
    RS AS (SELECT doc_id, char_start, char_end,
                  {sk.replacement_sql('text', 'type', 'action_mode', 'custom_replacement', _EXPORT_MODE_SQL)} AS rep
           FROM RPL WHERE status IN ('redacted', 'added') AND doc_id IN (SELECT doc_id FROM OPEN)),
    TX AS ({sk.rewrite_sql('RS')})
    SELECT t.doc_id, {_EXPORT_MODE_SQL} AS export_mode,
           CASE WHEN doc_id % 3 = 1 THEN 'anonymized_' ELSE 'redacted_' END || 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS out_name,
           CASE WHEN length(text) > 0 THEN text END AS text,
           CASE WHEN coalesce(length(text), 0) = 0 THEN 'Original document not found in session memory.' END AS error
    FROM TX t WHERE doc_id IN (SELECT doc_id FROM OPEN)""")
def reviewed_export(spark, sf_dir):
    """D1 -> G5 -> F2 -> F3 -> A9: the corrections log replayed, documents with nothing missed selected, their
    confirmed spans replaced by the reviewer's modes, one named output per document."""
    dets = cut_lineage(replayed(spark, sf_dir), "replayed")
    docs = cm.documents(spark, sf_dir)
    mode = F.when(F.pmod("doc_id", F.lit(3)) == 1, F.lit("anonymize")).otherwise(F.lit("redact"))
    gate = cut_lineage(rp.export_gate(rp.status_counts(dets, docs)), "gate")  # used three times
    manifest = io.export_manifest(_modes_records(spark, sf_dir).join(gate, "doc_id"), gate.withColumn("processed", F.lit(True))).drop("processed")
    spans = rd.confirmed(dets).join(gate, "doc_id").withColumn("rep", rd.replacement_text(
        F.col("text"), F.col("type"), F.col("action_mode"), F.col("custom_replacement"), mode))
    return io.export_files(rd.redact_documents(docs, spans, rows=manifest))


@register("named_files", f"""{REPLAYED_SQL},
    OPEN AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM RPL WHERE status = 'missed')),
    RS AS (SELECT doc_id, char_start, char_end,
                  {sk.replacement_sql('text', 'type', 'action_mode', 'custom_replacement', _EXPORT_MODE_SQL)} AS rep
           FROM RPL WHERE status IN ('redacted', 'added') AND doc_id IN (SELECT doc_id FROM OPEN)),
    TX AS ({sk.rewrite_sql('RS')})
    SELECT CASE WHEN doc_id % 3 = 1 THEN 'anonymized_' ELSE 'redacted_' END || 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS out_name, text
    FROM TX t WHERE doc_id IN (SELECT doc_id FROM OPEN) AND length(text) > 0""")
def named_files(spark, sf_dir):
    """The reviewed export as one named file per document, written with commit and abort, and read back by name."""
    path = os.path.join(ensure_checkpoint_dir(spark), "exports", uuid.uuid4().hex)
    nf.write_files(reviewed_export(spark, sf_dir), path)
    return nf.read_back(spark, path)


@register("csv_records", r"""
    WITH R AS (SELECT conv_id, turn, array_to_string(list_filter([CAST(turn AS VARCHAR), regexp_replace(role, '^\s+|\s+$', '', 'g'),
                 regexp_replace(replace(replace(text, chr(10), ''), chr(13), ''), '^\s+|\s+$', '', 'g')], lambda c: c <> ''), ' | ') AS line FROM conversations)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS text FROM R GROUP BY conv_id""")
def csv_records(spark, sf_dir):
    """A3: a CSV file of every conversation (number, role, quoted text with commas, quotes and line breaks) flattened to text."""
    t = read_table(spark, sf_dir, "conversations")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = t.select("conv_id", "turn", F.concat_ws(",", F.col("turn").cast("string"), quoted("role"), F.lit(" "), quoted("text")).alias("line"))
    files = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l")).select(
        "conv_id", F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("text"))
    return io.flatten_csv(files)
