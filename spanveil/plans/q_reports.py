"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import detect as dt
from ..operators import redact as rd
from ..operators import reports as rp
from ..session import read_table
from . import common as cm
from . import sqlkit as sk
from .q_review import _LOG_SQL, _RD
from .registry import register

# Reviewed detections in SQL (mirror of common.reviewed_detections).
_RV = f"""{_RD}, {_LOG_SQL},
    RV AS (SELECT doc_id, det_id, text, char_start, char_end, type, confidence,
                  CASE WHEN status IN ('missed', 'false_positive') AND char_start % 7 = 3 THEN 'dismissed' ELSE status END AS status,
                  source FROM RD
           UNION ALL
           SELECT doc_id, det_id, text, char_start, char_end, type, 1.0, 'added', 'manual' FROM CLOG WHERE action = 'add')"""

_COUNTS = """CNT AS (SELECT d.doc_id,
        count(CASE WHEN r.status = 'missed' THEN 1 END) AS missed,
        count(CASE WHEN r.status IN ('redacted', 'added') THEN 1 END) AS redacted,
        count(CASE WHEN r.status = 'false_positive' THEN 1 END) AS false_positive,
        count(CASE WHEN r.status = 'dismissed' THEN 1 END) AS dismissed,
        count(r.doc_id) AS total
      FROM documents d LEFT JOIN RV r ON r.doc_id = d.doc_id GROUP BY d.doc_id)"""


def _counts(spark, sf_dir):
    return rp.status_counts(cm.reviewed_detections(spark, sf_dir), read_table(spark, sf_dir, "documents"))


@register("status_counts", f"""{_RV}, {_COUNTS}
    SELECT doc_id, missed, redacted, false_positive, dismissed, total, total - missed - false_positive AS reviewed,
           CAST(CASE WHEN total > 0 THEN round((total - missed) / total * 100) ELSE 100 END AS BIGINT) AS progress
    FROM CNT""")
def status_counts(spark, sf_dir):
    """G1+G2: per-document review counters and progress."""
    return _counts(spark, sf_dir)


@register("type_stats", f"""{_RV}
    SELECT type, count(*) AS total, count_if(status IN ('redacted', 'added')) AS redacted,
           count_if(status = 'missed') AS missed FROM RV GROUP BY type""")
def type_stats(spark, sf_dir):
    """Per-type totals."""
    return rp.type_stats(cm.reviewed_detections(spark, sf_dir))


@register("type_rollup", f"""{_RV}
    SELECT source, type, count(*) AS total, count_if(status IN ('redacted', 'added')) AS redacted,
           CAST(grouping(source, type) AS BIGINT) AS level FROM RV GROUP BY ROLLUP (source, type)""")
def type_rollup(spark, sf_dir):
    """G3 extra: rollup(source, type)."""
    r = rp.type_rollup(cm.reviewed_detections(spark, sf_dir))
    return r.withColumn("level", F.col("level").cast("bigint"))


@register("safety_score", f"""{_RV}, {_COUNTS}
    SELECT doc_id,
           CASE WHEN total = 0 OR missed = 0 THEN 'A+' WHEN p >= 90 THEN 'A' WHEN p >= 70 THEN 'B' ELSE 'C' END AS grade,
           CASE WHEN total = 0 OR missed = 0 THEN 'Cleared for Export' WHEN p >= 90 THEN 'High Security'
                WHEN p >= 70 THEN 'Review Pending Items' ELSE 'Action Required' END AS label,
           CASE WHEN total = 0 OR missed = 0 THEN 100 ELSE p END AS score
    FROM (SELECT *, CAST(CASE WHEN total > 0 THEN round((redacted + dismissed) / total * 100) END AS BIGINT) AS p FROM CNT)""")
def safety_score(spark, sf_dir):
    """Safety grade per document."""
    return rp.safety_score(_counts(spark, sf_dir))


@register("export_gate", f"""{_RV}, {_COUNTS} SELECT doc_id FROM CNT WHERE missed = 0""")
def export_gate(spark, sf_dir):
    """Documents cleared for export (nothing missed)."""
    return rp.export_gate(_counts(spark, sf_dir))


@register("file_badges", f"""{_RV}, {_COUNTS}
    SELECT doc_id, CASE WHEN missed > 0 THEN CAST(missed AS VARCHAR) || ' pending' ELSE 'Ready' END AS badge FROM CNT""")
def file_badges(spark, sf_dir):
    """Sidebar badge per document."""
    return rp.file_badges(_counts(spark, sf_dir))


@register("source_mix", f"""{_RV}
    SELECT CASE WHEN source IN ('dual', 'heuristic', 'manual') THEN source ELSE 'model' END AS source_label,
           count(*) AS n FROM RV GROUP BY 1""")
def source_mix(spark, sf_dir):
    """Detections per source label."""
    d = cm.reviewed_detections(spark, sf_dir)
    return d.groupBy(rp.source_label(F.col("source")).alias("source_label")).agg(F.count(F.lit(1)).alias("n"))


@register("sanitization_audit", f"""{_RV}
    SELECT doc_id, 'links' AS section, '''' || text || ''' ➔ [Detached]' AS item, type FROM RV
    WHERE status IN ('redacted', 'added') AND type IN ('URL', 'EMAIL_ADDRESS')
    UNION ALL
    SELECT doc_id, 'tokens', text, type FROM RV WHERE status IN ('redacted', 'added')""")
def sanitization_audit(spark, sf_dir):
    """Detached links and secured tokens per document (text documents
    carry no metadata, so that section is empty here)."""
    return rp.sanitization_audit(cm.reviewed_detections(spark, sf_dir))


_PAGE_TITLE = next(t for f, t in tb.PDF_METADATA_AUDIT if f == "title").split("{v}")
_DETACHED = tb.DETACHED_DETECTION.split("{v}")


@register("page_audit", f"""
    WITH T AS (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
    S AS ({sk.pattern_spans_sql("SELECT page_id AS doc_id, html AS text FROM pages", tb.HEURISTIC_PATTERNS)})
    SELECT page_id AS doc_id, 'metadata' AS section, {sk.q(_PAGE_TITLE[0])} || title || {sk.q(_PAGE_TITLE[1])} AS item, NULL AS type FROM T WHERE title <> ''
    UNION ALL SELECT doc_id, 'tokens', m, type FROM S WHERE conf >= {tb.REDACT_AT}
    UNION ALL SELECT doc_id, 'links', {sk.q(_DETACHED[0])} || m || {sk.q(_DETACHED[1])}, type FROM S WHERE conf >= {tb.REDACT_AT} AND type = 'EMAIL_ADDRESS'""")
def page_audit(spark, sf_dir):
    """G7 of web pages: metadata that their export strips (F10, F9), detached links and secured tokens."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    meta = rd.metadata_map(rd.extract_metadata(F.col("text")))
    audit = pages.select("doc_id", rd.metadata_audit(meta, F.lit("pdf")).alias("audit"))
    return rp.sanitization_audit(dt.heuristic_detections(pages), audit)


def _progress_latency(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    start = ev.agg(F.min("ts").alias("t0"))
    per = ev.groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("t_done"))
    # one-row table: broadcasting it is bounded
    j = per.crossJoin(F.broadcast(start))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))  # noqa: E731  (naive timestamps read as UTC)
    return j.select("doc_id", ((us("t_done") - us("t0")) / 1e6).alias("latency_s"))


@register("latency_stats", """
    WITH P AS (SELECT user_id AS doc_id, (epoch_us(max(ts)) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6 AS latency_s
               FROM events GROUP BY user_id)
    SELECT count(*) AS n_files, max(latency_s) AS total_time_s, min(latency_s) AS time_to_first_s,
           count(*) / max(latency_s) AS files_per_s, min(latency_s) AS min_s, max(latency_s) AS max_s,
           avg(latency_s) AS mean_s, median(latency_s) AS median_s FROM P""")
def latency_stats(spark, sf_dir):
    """Batch latency report (events stand in for per-document progress)."""
    return rp.latency_stats(_progress_latency(spark, sf_dir))


@register("density_by_source", f"""{_RV}
    SELECT d.source, count(DISTINCT d.doc_id) AS n_docs, sum(length(d.text)) AS n_chars, sum(coalesce(c.n, 0)) AS n_detections,
           sum(coalesce(c.n, 0)) * 10000.0 / sum(length(d.text)) AS per_10k_chars
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM RV GROUP BY doc_id) c ON c.doc_id = d.doc_id
    GROUP BY d.source""")
def density_by_source(spark, sf_dir):
    """Entities per dataset (source) and per 10,000 characters."""
    docs = read_table(spark, sf_dir, "documents")
    n = cm.reviewed_detections(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = docs.join(n, "doc_id", "left")
    return j.groupBy("source").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_detections"),
        (F.sum(F.coalesce("n", F.lit(0))) * 10000.0 / F.sum(F.length("text"))).alias("per_10k_chars"))


@register("type_cube", f"""{_RV}
    SELECT d.lang, d.source, count(*) AS n_detections, count(DISTINCT r.type) AS n_types,
           CAST(grouping(d.lang, d.source) AS BIGINT) AS level
    FROM RV r JOIN documents d ON d.doc_id = r.doc_id GROUP BY CUBE (d.lang, d.source)""")
def type_cube(spark, sf_dir):
    """G11 (extension): detections and distinct types by language and source, all groupings."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = cm.reviewed_detections(spark, sf_dir).drop("source").join(docs, "doc_id")
    return j.cube("lang", "source").agg(F.count(F.lit(1)).alias("n_detections"),
                                        F.countDistinct("type").alias("n_types"),
                                        F.grouping_id().cast("bigint").alias("level"))
