"""Inputs shared by the registered queries: given tables and the small
derived tables every query builds on (policies per document, detections)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import detect as dt
from ..session import cut_lineage, read_table, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, spread over the cores for the work on the texts."""
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def policy_of(doc_id: Column) -> Column:
    """Policy derived from doc_id; the ninth name is unknown on purpose (mixed_general's rules hold for it)."""
    names = tb.POLICY_NAMES + ["unknown_policy"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(doc_id, F.lit(len(names))) + 1).cast("int"))


def doc_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", policy_of(F.col("doc_id")).alias("policy"))


def model_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    raw = dt.standin_raw_entities(docs)
    return dt.policy_filter(raw, dt.resolve_policies(doc_policies(spark, sf_dir)))


def documents_with_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("policy", policy_of(F.col("doc_id")))


def detections(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Full detection pipeline output over the documents table, one narrow stage.
    Queries that read the detections in many branches
    (review log replay, reports) pass ``materialize`` to write the small
    detection table once to the shared checkpoint folder."""
    out = dt.detect_pipeline(documents_with_policy(spark, sf_dir))
    return cut_lineage(out, "detections") if materialize else out


MODES = ["redact", "anonymize", "highlight_red"]
GLOBAL_MODES = ["redact", "anonymize", "highlight"]


def with_review_modes(dets: DataFrame) -> DataFrame:
    """Derive per-detection action modes, custom replacements and the
    document's export mode from the offsets (reproducible scenario data)."""
    action, custom, whole = review_modes(F.col("doc_id"), F.col("char_start"))
    return dets.select("*", action.alias("action_mode"), custom.alias("custom_replacement"), whole.alias("global_mode"))


def review_modes(doc_id: Column, char_start: Column) -> tuple[Column, Column, Column]:
    """(action_mode, custom_replacement, global_mode)"""
    k4, k7, k3 = F.pmod(char_start, F.lit(4)), F.pmod(char_start, F.lit(7)), F.pmod(doc_id, F.lit(3))
    return (F.when(k4 == 0, "redact").when(k4 == 1, "anonymize").when(k4 == 2, "highlight_red"),
            F.when(k7 == 0, "  [Hidden]  ").when(k7 == 1, "   "),
            F.when(k3 == 0, "redact").when(k3 == 1, "anonymize").otherwise("highlight"))


MODES_SQL = """CASE char_start % 4 WHEN 0 THEN 'redact' WHEN 1 THEN 'anonymize' WHEN 2 THEN 'highlight_red' END AS action_mode,
    CASE char_start % 7 WHEN 0 THEN '  [Hidden]  ' WHEN 1 THEN '   ' END AS custom_replacement,
    CASE doc_id % 3 WHEN 0 THEN 'redact' WHEN 1 THEN 'anonymize' ELSE 'highlight' END AS global_mode"""


def doc_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review sessions: one reviewer session per block of 10 documents."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("s"), F.floor(F.col("doc_id") / 10).cast("string")).alias("session_id"))


def with_review_status(dets: DataFrame) -> DataFrame:
    """Scenario statuses: some missed detections were marked false positive."""
    fp = (F.col("status") == "missed") & (F.pmod(F.col("char_start"), F.lit(5)) == 0)
    return dets.withColumn("status", F.when(fp, F.lit("false_positive")).otherwise(F.col("status")))


def corrections_log(spark: SparkSession, sf_dir: str, dets: DataFrame | None = None) -> DataFrame:
    """Reproducible corrections log derived from the detections and documents.

    Actions of a session are numbered by document and place.  Per detection: accept, dismiss, mark false positive with
    a mode, delete, update-then-undo, or a bare undo; per document: bulk
    accept, a manual add of its first long word, bulk update, session-wide
    bulk accept or reject, a delete of a missing id, an undo.
    """
    dets = dets if dets is not None else with_review_status(detections(spark, sf_dir))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sess = "concat('s', CAST(floor(doc_id / 10) AS STRING))"
    add_id = ("substring(sha2(concat_ws('|', CAST(doc_id AS STRING), CAST(ws AS STRING), "
              "CAST(ws + length(w) AS STRING), 'CUSTOM'), 256), 1, 16)")
    kinds = ", ".join(f"named_struct('k', {k}, 'a', '{a}')" for k, a in enumerate(
        ["bulk_accept", "add", "bulk_update", "bulk_accept_global", "bulk_reject_global", "delete", "undo"]))
    return spark.sql(f"""
    WITH PD AS (SELECT doc_id, det_id, pmod(char_start + doc_id, 10) AS h,
                       char_start AS at FROM {{dets}}),
    DW AS (SELECT doc_id, w, CAST(instr(text, w) - 1 AS BIGINT) AS ws
           FROM (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{{{{6,}}}}', 0) AS w FROM {{docs}})),
    DA AS (SELECT doc_id, w, ws, x.k AS k, x.a AS a FROM DW LATERAL VIEW explode(array({kinds})) t AS x
           WHERE (x.k = 0 AND pmod(doc_id, 5) = 0) OR (x.k = 1 AND pmod(doc_id, 7) = 0 AND length(w) > 0)
              OR (x.k = 2 AND pmod(doc_id, 11) = 0)
              OR (x.k = 3 AND pmod(doc_id, 10) = 9 AND pmod(floor(doc_id / 10), 3) = 0)
              OR (x.k = 4 AND pmod(doc_id, 10) = 9 AND pmod(floor(doc_id / 10), 3) = 1)
              OR (x.k = 5 AND pmod(doc_id, 13) = 0) OR (x.k = 6 AND pmod(doc_id, 17) = 0))
    SELECT * EXCEPT (at, nth), row_number() OVER (PARTITION BY session_id ORDER BY doc_id, at, nth) AS seq FROM (
    SELECT {sess} AS session_id, at, 0 AS nth, doc_id,
           CASE WHEN h = 5 THEN 'delete' WHEN h = 7 THEN 'undo' ELSE 'update' END AS action,
           CASE WHEN h <> 7 THEN det_id END AS det_id,
           CASE WHEN h <= 2 THEN 'redacted' WHEN h = 3 THEN 'dismissed' WHEN h = 4 THEN 'false_positive'
                WHEN h = 6 THEN 'missed' END AS status,
           CASE WHEN h = 4 THEN 'anonymize' END AS action_mode,
           CASE WHEN h = 4 THEN ' [Masked] ' END AS custom_replacement,
           CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS BIGINT) AS char_start, CAST(NULL AS BIGINT) AS char_end,
           CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS type
    FROM PD WHERE h <= 7
    UNION ALL
    SELECT {sess}, at, 1, doc_id, 'undo', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM PD WHERE h = 6
    UNION ALL
    SELECT {sess}, 9223372036854775807, k, doc_id, a,
           CASE WHEN a = 'delete' THEN concat('missing-', CAST(doc_id AS STRING)) WHEN a = 'add' THEN {add_id} END,
           CASE WHEN a = 'bulk_update' THEN 'dismissed' END, NULL, NULL,
           CAST(CASE WHEN a = 'bulk_accept' THEN 0.5 WHEN a = 'bulk_accept_global' THEN 0.45 END AS DOUBLE),
           CASE WHEN a = 'add' THEN ws END, CASE WHEN a = 'add' THEN ws + length(w) END,
           CASE WHEN a = 'add' THEN w END, CASE WHEN a = 'add' THEN 'CUSTOM' END
    FROM DA)""", dets=dets.select("doc_id", "det_id", "char_start"), docs=docs)


def reviewed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections after a review pass: scenario statuses, some items
    dismissed, and the manual additions of the corrections log as 'added'."""
    rd = with_review_status(detections(spark, sf_dir, materialize=True))
    dismiss = F.col("status").isin("missed", "false_positive") & (F.pmod(F.col("char_start"), F.lit(7)) == 3)
    base = rd.withColumn("status", F.when(dismiss, F.lit("dismissed")).otherwise(F.col("status")))
    cols = ["doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status", "source"]
    adds = corrections_log(spark, sf_dir, rd).filter(F.col("action") == "add").select(
        "doc_id", "det_id", "text", "char_start", "char_end", "type", F.lit(1.0).alias("confidence"),
        F.lit("added").alias("status"), F.lit("manual").alias("source"))
    return base.select(*cols).unionByName(adds)
