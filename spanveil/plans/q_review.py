"""Registered review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import review as rv
from ..session import cut_lineage
from . import common as cm
from . import sqlkit as sk
from .registry import register

# Detections with scenario statuses (some missed ones marked false_positive).
_RD = f"""WITH {sk.pipeline_sql()},
    RD AS (SELECT * REPLACE (CASE WHEN status = 'missed' AND char_start % 5 = 0 THEN 'false_positive' ELSE status END AS status)
           FROM DET)"""

_LOG_SQL = f"""
    PD AS (SELECT doc_id, det_id, char_start, (char_start + doc_id) % 10 AS h,
                  char_start AS place FROM RD),
    DW AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]{{6,}}', 0) AS w,
                  CAST(instr(text, regexp_extract(text, '[A-Za-z]{{6,}}', 0)) - 1 AS BIGINT) AS ws FROM documents),
    DA AS (SELECT doc_id, w, ws, k, a FROM DW, (VALUES (0, 'bulk_accept'), (1, 'add'), (2, 'bulk_update'),
                  (3, 'bulk_accept_global'), (4, 'bulk_reject_global'), (5, 'delete'), (6, 'undo')) AS t(k, a)
           WHERE (k = 0 AND doc_id % 5 = 0) OR (k = 1 AND doc_id % 7 = 0 AND length(w) > 0)
              OR (k = 2 AND doc_id % 11 = 0) OR (k = 3 AND doc_id % 10 = 9 AND (doc_id // 10) % 3 = 0)
              OR (k = 4 AND doc_id % 10 = 9 AND (doc_id // 10) % 3 = 1) OR (k = 5 AND doc_id % 13 = 0)
              OR (k = 6 AND doc_id % 17 = 0)),
    CLOG AS (SELECT * EXCLUDE (place, nth), row_number() OVER (PARTITION BY session_id ORDER BY doc_id, place, nth) AS seq FROM (
      SELECT 's' || CAST(doc_id // 10 AS VARCHAR) AS session_id, place, 0 AS nth, doc_id,
             CASE WHEN h = 5 THEN 'delete' WHEN h = 7 THEN 'undo' ELSE 'update' END AS action,
             CASE WHEN h <> 7 THEN det_id END AS det_id,
             CASE WHEN h <= 2 THEN 'redacted' WHEN h = 3 THEN 'dismissed' WHEN h = 4 THEN 'false_positive'
                  WHEN h = 6 THEN 'missed' END AS status,
             CASE WHEN h = 4 THEN 'anonymize' END AS action_mode, CASE WHEN h = 4 THEN ' [Masked] ' END AS custom_replacement,
             CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS BIGINT) AS char_start, CAST(NULL AS BIGINT) AS char_end,
             CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS type
      FROM PD WHERE h <= 7
      UNION ALL
      SELECT 's' || CAST(doc_id // 10 AS VARCHAR), place, 1, doc_id, 'undo', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM PD WHERE h = 6
      UNION ALL
      SELECT 's' || CAST(doc_id // 10 AS VARCHAR), 9223372036854775807, k, doc_id, a,
             CASE WHEN a = 'delete' THEN 'missing-' || CAST(doc_id AS VARCHAR)
                  WHEN a = 'add' THEN {sk.det_id_sql('doc_id', 'ws', 'ws + length(w)', "'CUSTOM'")} END,
             CASE WHEN a = 'bulk_update' THEN 'dismissed' END, NULL, NULL,
             CASE WHEN a = 'bulk_accept' THEN 0.5 WHEN a = 'bulk_accept_global' THEN 0.45 END,
             CASE WHEN a = 'add' THEN ws END, CASE WHEN a = 'add' THEN ws + length(w) END,
             CASE WHEN a = 'add' THEN w END, CASE WHEN a = 'add' THEN 'CUSTOM' END
      FROM DA))
"""

_LOG_COLS = ("session_id, seq, doc_id, action, det_id, status, action_mode, custom_replacement, threshold, "
             "char_start, char_end, text, type")


def _rd(spark, sf_dir):
    return cm.with_review_status(cm.detections(spark, sf_dir, materialize=True))


def _log(spark, sf_dir, dets):
    """The log, derived from the texts once."""
    return cut_lineage(cm.corrections_log(spark, sf_dir, dets), "corrections-log")


@register("corrections_log", f"{_RD}, {_LOG_SQL} SELECT {_LOG_COLS} FROM CLOG")
def corrections_log(spark, sf_dir):
    """The reproducible corrections log every review query replays."""
    return cm.corrections_log(spark, sf_dir, _rd(spark, sf_dir)).select(*[c.strip() for c in _LOG_COLS.split(",")])


@register("correction_errors", f"""{_RD}, {_LOG_SQL}
    SELECT session_id, seq, action, det_id, 'Detection ' || det_id || ' not found' AS error
    FROM CLOG WHERE action IN ('update', 'delete') AND det_id NOT IN (SELECT det_id FROM RD)""")
def correction_errors(spark, sf_dir):
    """Updates and deletes of unknown detections are error rows."""
    d = _rd(spark, sf_dir)
    return rv.correction_errors(d, cm.corrections_log(spark, sf_dir, d))


#: the undo stack (the last 20 undoable actions) carried along each session's actions
_UNDO_SQL = f"""
    UA AS (SELECT session_id, seq, action, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM CLOG
           WHERE action IN ('update', 'bulk_accept', 'bulk_update', 'bulk_accept_global', 'bulk_reject_global', 'undo')),
    UW(session_id, i, st, cx) AS (
      SELECT DISTINCT session_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM UA
      UNION ALL
      SELECT w.session_id, w.i + 1,
             CASE WHEN a.action = 'undo' THEN w.st[1:greatest(len(w.st) - 1, 0)]
                  ELSE list_append(CASE WHEN len(w.st) >= {tb.UNDO_DEPTH} THEN w.st[2:] ELSE w.st END, a.seq) END,
             CASE WHEN a.action = 'undo' AND len(w.st) > 0 THEN list_append(w.cx, w.st[-1]) ELSE w.cx END
      FROM UW w JOIN UA a ON a.session_id = w.session_id AND a.i = w.i + 1),
    UX AS (SELECT session_id, unnest(arg_max(cx, i)) AS seq FROM UW GROUP BY session_id)"""

_REPLAY_SQL = f"""
    ADDED AS (SELECT doc_id, {sk.det_id_sql()} AS det_id, text, char_start, char_end, type, 1.0::DOUBLE AS confidence, 'redacted' AS status,
                     'manual' AS source, seq AS born FROM CLOG WHERE action = 'add'),
    GONE AS (SELECT det_id, max(seq) AS last FROM CLOG WHERE action = 'delete' GROUP BY det_id),
    RA AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY coalesce(born, -1) DESC) AS latest FROM (
             SELECT doc_id, det_id, text, char_start, char_end, type, confidence, status, source, NULL::BIGINT AS born FROM RD
             UNION ALL SELECT * FROM ADDED)),
    RB AS (SELECT x.* EXCLUDE (latest), 's' || CAST(x.doc_id // 10 AS VARCHAR) AS session_id FROM RA x LEFT JOIN GONE g ON g.det_id = x.det_id
           WHERE x.latest = 1 AND (g.last IS NULL OR coalesce(x.born > g.last, false))),
    LIVE AS (SELECT * FROM CLOG WHERE action NOT IN ('undo', 'add', 'delete') AND (session_id, seq) NOT IN (SELECT (session_id, seq) FROM UX)),
    AC AS (SELECT DISTINCT b.det_id, l.seq, l.action, l.status, l.threshold FROM RB b JOIN LIVE l ON l.session_id = b.session_id AND l.seq > coalesce(b.born, -1)
           AND ((l.action = 'update' AND l.det_id = b.det_id) OR (l.action IN ('bulk_accept', 'bulk_update') AND l.doc_id = b.doc_id)
                OR l.action IN ('bulk_accept_global', 'bulk_reject_global'))),
    AN AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY seq) AS i FROM AC),
    RF(det_id, confidence, i, s) AS (
      SELECT DISTINCT det_id, confidence, 0::BIGINT, status FROM RB
      UNION ALL
      SELECT f.det_id, f.confidence, f.i + 1, CASE
               WHEN a.action = 'update' THEN a.status
               WHEN a.action IN ('bulk_accept', 'bulk_accept_global') THEN CASE WHEN f.s = 'missed' AND f.confidence >= a.threshold THEN 'redacted' ELSE f.s END
               WHEN a.action = 'bulk_update' THEN CASE WHEN f.s IN ('missed', 'false_positive') THEN a.status ELSE f.s END
               ELSE CASE WHEN f.s IN ('missed', 'false_positive') THEN 'dismissed' ELSE f.s END END
      FROM RF f JOIN AN a ON a.det_id = f.det_id AND a.i = f.i + 1),
    RL AS (SELECT det_id, arg_max(s, i) AS s FROM RF GROUP BY det_id),
    MO AS (SELECT det_id, arg_max(action_mode, seq) FILTER (WHERE action_mode IS NOT NULL) AS action_mode,
                  arg_max(custom_replacement, seq) FILTER (WHERE custom_replacement IS NOT NULL) AS custom_replacement
           FROM CLOG WHERE action = 'update' GROUP BY det_id),
    RPL AS (SELECT b.doc_id, b.det_id, b.text, b.char_start, b.char_end, b.type, b.confidence, l.s AS status, b.status AS status_before_review,
                   m.action_mode, m.custom_replacement, b.source
            FROM RB b JOIN RL l ON l.det_id = b.det_id LEFT JOIN MO m ON m.det_id = b.det_id)"""
_RD_RECURSIVE = _RD.replace("WITH", "WITH RECURSIVE", 1)
REPLAYED_SQL = f"{_RD_RECURSIVE}, {_LOG_SQL}, {_UNDO_SQL}, {_REPLAY_SQL}"


def replayed(spark, sf_dir):
    d = _rd(spark, sf_dir)
    return rv.replay(d, _log(spark, sf_dir, d), cm.doc_sessions(spark, sf_dir))


@register("apply_corrections", f"""{REPLAYED_SQL}
    SELECT doc_id, det_id, char_start, char_end, type, status, status_before_review, action_mode, custom_replacement, source FROM RPL""")
def apply_corrections(spark, sf_dir):
    """D1+D3+D4+D10: replay of the whole log with undo."""
    return replayed(spark, sf_dir).select("doc_id", "det_id", "char_start", "char_end", "type", "status", "status_before_review",
                                          "action_mode", "custom_replacement", "source")


@register("replay_with_undo", f"""{_RD_RECURSIVE}, {_LOG_SQL}, {_UNDO_SQL} SELECT session_id, seq FROM UX""")
def replay_with_undo(spark, sf_dir):
    """Actions whose status effect is undone, per session."""
    d = _rd(spark, sf_dir)
    return rv.cancelled_actions(_log(spark, sf_dir, d))


_SEL = "doc_id, det_id, char_start, confidence, status"


@register("bulk_accept", f"""{_RD}
    SELECT doc_id, det_id, char_start, confidence,
           CASE WHEN status = 'missed' AND confidence >= 0.5 + (doc_id % 4) / 10.0 THEN 'redacted' ELSE status END AS status
    FROM RD""")
def bulk_accept(spark, sf_dir):
    """Per document, missed items at or above the document's threshold
    (0.5, 0.6, 0.7 or 0.8 by document) become redacted."""
    d = _rd(spark, sf_dir)
    thr = F.lit(0.5) + F.pmod(F.col("doc_id"), F.lit(4)) / 10.0
    cond = (F.col("status") == "missed") & (F.col("confidence") >= thr)
    return d.select("doc_id", "det_id", "char_start", "confidence",
                    F.when(cond, F.lit("redacted")).otherwise(F.col("status")).alias("status"))


@register("bulk_accept_global", f"""{_RD}
    SELECT {_SEL.replace('status', "CASE WHEN status = 'missed' AND confidence >= 0.6 THEN 'redacted' ELSE status END AS status")} FROM RD""")
def bulk_accept_global(spark, sf_dir):
    """Missed at or above 0.6 becomes redacted in every document."""
    return rv.bulk_accept(_rd(spark, sf_dir), 0.6).select(*_SEL.split(", "))


@register("bulk_reject_global", f"""{_RD}
    SELECT {_SEL.replace('status', "CASE WHEN status IN ('missed', 'false_positive') THEN 'dismissed' ELSE status END AS status")} FROM RD""")
def bulk_reject_global(spark, sf_dir):
    """Missed or false_positive becomes dismissed everywhere."""
    return rv.bulk_reject(_rd(spark, sf_dir)).select(*_SEL.split(", "))


@register("bulk_update_doc", f"""{_RD}
    SELECT doc_id, det_id, char_start, confidence,
           CASE WHEN status IN ('missed', 'false_positive') THEN (CASE WHEN doc_id % 2 = 0 THEN 'dismissed' ELSE 'redacted' END)
                ELSE status END AS status FROM RD""")
def bulk_update_doc(spark, sf_dir):
    """Per document, open items get the reviewer's status (dismissed for
    even documents, redacted for odd ones)."""
    d = _rd(spark, sf_dir)
    new = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("dismissed")).otherwise(F.lit("redacted"))
    return d.select("doc_id", "det_id", "char_start", "confidence",
                    F.when(F.col("status").isin("missed", "false_positive"), new).otherwise(F.col("status")).alias("status"))


_GRID = [round(0.40 + 0.05 * i, 2) for i in range(12)]


@register("threshold_sweep", f"""{_RD}
    SELECT r.doc_id, g.threshold, count(*) FILTER (WHERE r.status = 'missed' AND r.confidence >= g.threshold) AS would_accept
    FROM RD r, (SELECT unnest([{', '.join(str(x) for x in _GRID)}])::DOUBLE AS threshold) g GROUP BY r.doc_id, g.threshold""")
def threshold_sweep(spark, sf_dir):
    """Per document, how many missed items each threshold would accept."""
    return rv.threshold_sweep(_rd(spark, sf_dir), _GRID)


@register("manual_add", f"""{_RD}, {_LOG_SQL}
    SELECT doc_id, det_id, text, char_start, char_end, type, confidence, status, source,
           row_number() OVER (PARTITION BY doc_id ORDER BY char_start, grp) AS list_pos
    FROM (SELECT doc_id, det_id, text, char_start, char_end, type, confidence, status, source, 0 AS grp FROM RD
          UNION ALL
          SELECT doc_id, det_id, text, char_start, char_end, type, 1.0, 'redacted', 'manual', 1 FROM CLOG WHERE action = 'add')""")
def manual_add(spark, sf_dir):
    """D3: manual additions (confidence 1.0, redacted, manual) kept in start order."""
    from pyspark.sql import Window
    d = _rd(spark, sf_dir)
    log = cm.corrections_log(spark, sf_dir, d)
    adds = rv.manual_detections(log.filter(F.col("action") == "add"))
    cols = ["doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status", "source"]
    u = d.select(*cols, F.lit(0).alias("grp")).unionByName(adds.select(*cols, F.lit(1).alias("grp")))
    w = Window.partitionBy("doc_id").orderBy("char_start", "grp")
    return u.withColumn("list_pos", F.row_number().over(w)).drop("grp")


@register("delete_detections", f"""{_RD}, {_LOG_SQL}
    SELECT doc_id, det_id, status FROM RD WHERE det_id NOT IN (SELECT det_id FROM CLOG WHERE action = 'delete')""")
def delete_detections(spark, sf_dir):
    """Detections left after the deletes of the log (left anti join)."""
    d = _rd(spark, sf_dir)
    dels = cm.corrections_log(spark, sf_dir, d).filter(F.col("action") == "delete")
    kept, _ = rv.delete_detections(d, dels)
    return kept.select("doc_id", "det_id", "status")


_PATCH_SQL = """PATCH AS (
      SELECT doc_id * 10 + 1 AS seq, doc_id, det_id, char_start, char_end, 'dismissed' AS status, text, type, confidence
      FROM RD WHERE char_start % 3 = 0
      UNION ALL
      SELECT doc_id * 10 + 2, doc_id, 'client-' || det_id, char_start, char_end, 'redacted', text, type, confidence
      FROM RD WHERE char_start % 3 = 1
      UNION ALL
      SELECT doc_id * 10 + 3, doc_id, 'client-new-' || det_id, char_end + 1, char_end + 5, 'redacted', 'x', 'CUSTOM', 1.0
      FROM RD WHERE char_start % 3 = 2)"""


def _patches(d):
    k = F.pmod(F.col("char_start"), F.lit(3))
    a = d.filter(k == 0).select((F.col("doc_id") * 10 + 1).alias("seq"), "doc_id", "det_id", "char_start", "char_end",
                                F.lit("dismissed").alias("status"), "text", "type", "confidence")
    b = d.filter(k == 1).select((F.col("doc_id") * 10 + 2).alias("seq"), "doc_id",
                                F.concat(F.lit("client-"), F.col("det_id")).alias("det_id"), "char_start", "char_end",
                                F.lit("redacted").alias("status"), "text", "type", "confidence")
    c = d.filter(k == 2).select((F.col("doc_id") * 10 + 3).alias("seq"), "doc_id",
                                F.concat(F.lit("client-new-"), F.col("det_id")).alias("det_id"),
                                (F.col("char_end") + 1).alias("char_start"), (F.col("char_end") + 5).alias("char_end"),
                                F.lit("redacted").alias("status"), F.lit("x").alias("text"), F.lit("CUSTOM").alias("type"),
                                F.lit(1.0).alias("confidence"))
    return a.unionByName(b).unionByName(c)


@register("upsert_detections", f"""{_RD}, {_PATCH_SQL},
    BYID AS (SELECT p.* FROM PATCH p WHERE p.det_id IN (SELECT det_id FROM RD)),
    REST AS (SELECT p.* FROM PATCH p WHERE p.det_id NOT IN (SELECT det_id FROM RD)),
    FS AS (SELECT doc_id, char_start, char_end, min(det_id) AS tid FROM RD GROUP BY ALL),
    BYSPAN AS (SELECT r.*, fs.tid FROM REST r LEFT JOIN FS fs USING (doc_id, char_start, char_end)),
    HITS AS (SELECT * FROM (
               SELECT seq, det_id AS tid, NULL AS new_id, NULL AS new_text, NULL AS new_type, NULL AS new_conf, status AS new_status, 'id' AS mby FROM BYID
               UNION ALL SELECT seq, tid, det_id, text, type, confidence, status, 'span' FROM BYSPAN WHERE tid IS NOT NULL)
             QUALIFY row_number() OVER (PARTITION BY tid ORDER BY seq DESC) = 1)
    SELECT r.doc_id, coalesce(h.new_id, r.det_id) AS det_id, coalesce(h.new_text, r.text) AS text, r.char_start, r.char_end,
           coalesce(h.new_type, r.type) AS type, coalesce(h.new_conf, r.confidence) AS confidence,
           coalesce(h.new_status, r.status) AS status, coalesce(h.mby, 'unchanged') AS matched_by
    FROM RD r LEFT JOIN HITS h ON h.tid = r.det_id
    UNION ALL
    SELECT doc_id, det_id, text, char_start, char_end, type, confidence, status, 'appended' FROM BYSPAN WHERE tid IS NULL""")
def upsert_detections(spark, sf_dir):
    """Patches matched by id, else by equal span, else appended."""
    d = _rd(spark, sf_dir)
    return rv.upsert_detections(d, _patches(d))


_TRIAGE_SQL = """TR AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN status = 'missed' THEN 0 ELSE 1 END,
                         CASE WHEN status = 'missed' THEN -confidence ELSE confidence END, char_start, det_id) AS triage_rank
           FROM RD WHERE status IN ('missed', 'false_positive'))"""


@register("triage_queue", f"""{_RD}, {_TRIAGE_SQL} SELECT doc_id, det_id, status, confidence, triage_rank FROM TR""")
def triage_queue(spark, sf_dir):
    """Missed first (high confidence first), then false positives (low first)."""
    return rv.triage_order(_rd(spark, sf_dir)).select("doc_id", "det_id", "status", "confidence", "triage_rank")


@register("triage_top5", f"""{_RD}, {_TRIAGE_SQL}
    SELECT doc_id, det_id, triage_rank, greatest(n - 5, 0) AS more FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM TR) WHERE triage_rank <= 5""")
def triage_top5(spark, sf_dir):
    """The first five triage items per document and '+N more'."""
    return rv.triage_top(_rd(spark, sf_dir)).select("doc_id", "det_id", "triage_rank", F.col("more").cast("bigint"))


@register("triage_neighbours", f"""{_RD}, {_TRIAGE_SQL}
    SELECT doc_id, det_id, triage_rank,
           coalesce(lead(det_id) OVER w, first_value(det_id) OVER wa) AS next_det_id,
           coalesce(lag(det_id) OVER w, last_value(det_id) OVER wa) AS prev_det_id
    FROM TR WINDOW w AS (PARTITION BY doc_id ORDER BY triage_rank),
                   wa AS (PARTITION BY doc_id ORDER BY triage_rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def triage_neighbours(spark, sf_dir):
    """Cyclic next and previous item in triage order."""
    return rv.triage_neighbours(_rd(spark, sf_dir))


@register("status_transitions", f"""{_RD}
    SELECT status AS previous_status,
           CASE WHEN status IN ('missed', 'false_positive') THEN
                CASE WHEN status = 'missed' AND confidence >= 0.6 THEN 'redacted' ELSE 'dismissed' END
                ELSE status END AS new_status, count(*) AS n
    FROM RD GROUP BY ALL""")
def status_transitions(spark, sf_dir):
    """Previous vs new status after a global accept (0.6) then a global reject."""
    d = _rd(spark, sf_dir).withColumn("status_before_review", F.col("status"))
    return rv.status_transitions(rv.bulk_reject(rv.bulk_accept(d, 0.6)))
