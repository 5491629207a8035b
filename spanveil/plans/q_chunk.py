"""Registered chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import chunk as ch
from ..operators import detect as dt
from ..operators import model_hook as mh
from . import common as cm
from . import sqlkit as sk
from .registry import register


def chunks_sql() -> str:
    """Recursive CTE ``C`` with the same cut rule (last newline / space found
    with a greedy regex over the tail window)."""
    mx, ov, nw, sw = tb.CHUNK_MAX_CHARS, tb.CHUNK_OVERLAP, tb.CHUNK_NEWLINE_WINDOW - 1, tb.CHUNK_SPACE_WINDOW - 1

    def cut(s: str) -> str:
        e0 = f"least({s} + {mx}, n)"
        wn = f"substr(t, {e0} - {nw} + 1, {nw})"
        ws = f"substr(t, {e0} - {sw} + 1, {sw})"
        return f"""CASE WHEN {e0} >= n THEN {e0}
                     WHEN regexp_matches({wn}, '\\n') THEN {e0} - {nw} + length(regexp_extract({wn}, '(?s)^(.*)\\n', 1))
                     WHEN regexp_matches({ws}, ' ') THEN {e0} - {sw} + length(regexp_extract({ws}, '(?s)^(.*) ', 1))
                     ELSE {e0} END"""

    return f"""
    RECURSIVE C(doc_id, chunk_idx, s, e, n, t) AS (
      SELECT doc_id, 0, 0, CASE WHEN n <= {mx} THEN n ELSE {cut('0')} END, n, t
      FROM (SELECT doc_id, coalesce(length(text), 0) AS n, coalesce(text, '') AS t FROM documents)
      UNION ALL
      SELECT doc_id, chunk_idx + 1, greatest(e - {ov}, 0), {cut(f'greatest(e - {ov}, 0)')}, n, t
      FROM C WHERE e < n
    ),
    CH AS (SELECT doc_id, chunk_idx, CAST(s AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset,
                  CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks,
                  substr(t, s + 1, e - s) AS text, t AS doc FROM C)
    """


@register("chunk_documents", f"""WITH {chunks_sql()}
    SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, start_offset, end_offset, n_chunks, text FROM CH""")
def chunk_documents(spark, sf_dir):
    """B1: overlapping windows of at most 3500 characters with exact offsets."""
    return ch.chunk_documents(cm.documents(spark, sf_dir))


@register("chunk_stats", f"""WITH {chunks_sql()}
    SELECT n_chunks, count(DISTINCT doc_id) AS n_docs, count(*) AS n_rows,
           sum(end_offset - start_offset) AS chunk_chars FROM CH GROUP BY n_chunks""")
def chunk_stats(spark, sf_dir):
    """B1 summary: documents and characters per chunk count."""
    c = ch.chunk_documents(cm.documents(spark, sf_dir), keep_text=False)
    return c.groupBy("n_chunks").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_rows"),
                                     F.sum(F.col("end_offset") - F.col("start_offset")).alias("chunk_chars"))


def _chunk_spans_sql() -> str:
    pats = [(label, regex, label, 0.0, "") for label, regex in tb.STANDIN_ENTITY_PATTERNS]
    src = "SELECT k, text FROM CK"
    return f"""
    CK AS (SELECT *, row_number() OVER () AS k FROM CH),
    RAW AS (SELECT DISTINCT c.doc_id, x.type AS label, CAST(x.s + c.start_offset AS BIGINT) AS char_start,
                   CAST(x.e + c.start_offset AS BIGINT) AS char_end, x.m AS text,
                   CAST(round(0.40 + ((c.doc_id * 37 + x.s + c.start_offset) % 60) / 100.0, 2) AS DOUBLE) AS score
            FROM ({sk.pattern_spans_sql(src, pats, 'k', 'text')}) x JOIN CK c ON c.k = x.doc_id),
    RK AS (SELECT r.doc_id, r.char_start, r.char_end, r.label AS type, r.score AS confidence, '' AS status, '' AS reason, '' AS source,
                  NULL AS policy, NULL AS rule, r.char_end AS o1, r.label AS o2, d.text AS doc
           FROM RAW r JOIN documents d ON d.doc_id = r.doc_id),
    {sk.islands_sql('RK', 'o1, o2')}
    """


ORACLE_DETECT_CHUNKED = f"""WITH {chunks_sql()}, {_chunk_spans_sql()}
    SELECT doc_id, type AS label, char_start, char_end, text, confidence AS score FROM FI"""


@register("detect_chunked", ORACLE_DETECT_CHUNKED)
def detect_chunked(spark, sf_dir):
    """C15 on chunks: entity patterns run per chunk, offsets move to the
    document (B2), and what overlaps across chunks is united (C14)."""
    chunks = ch.chunk_documents(cm.documents(spark, sf_dir))
    pats = [(label, regex, label, 0.0, "") for label, regex in tb.STANDIN_ENTITY_PATTERNS]
    spans = ch.to_document_offsets(dt.pattern_spans(chunks, pats, keep=["start_offset"]))
    return ch.union_across_chunks(dt.standin_from_spans(spans))


@register("model_hook", ORACLE_DETECT_CHUNKED)
def model_hook(spark, sf_dir):
    """The model hook (Arrow batches of chunks, scorer loaded once per
    task) with the stand-in scorer equals the pattern form of chunked detection."""
    return ch.union_across_chunks(mh.score_chunks(ch.chunk_documents(cm.documents(spark, sf_dir))))


@register("detect_with_hook", f"WITH {sk.pipeline_sql()} SELECT * FROM DET")
def detect_with_hook(spark, sf_dir):
    """I1 -> C17: each document's labels and threshold go to the model, its entities through the pipeline;
    with the stand-in scorer this equals the pipeline over whole documents."""
    docs = cm.documents_with_policy(spark, sf_dir)
    asked = docs.join(dt.resolve_policies(docs.select("doc_id", "policy")).drop("policy", "rule"), "doc_id")
    raw = mh.score_chunks(ch.chunk_documents(asked, keep=["labels", "threshold"]))
    return dt.detect_pipeline(docs, raw_entities=raw)
