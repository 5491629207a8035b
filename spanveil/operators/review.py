"""Review corrections as an append-only log applied to the detection table
(D1-D14).

Log schema (``corrections``): session_id, seq, doc_id, action, det_id,
status, action_mode, custom_replacement, threshold, char_start, char_end,
text, type.  Actions: update, add, delete, bulk_accept, bulk_update,
bulk_accept_global, bulk_reject_global, undo.

Undo and status actions are associative summaries, merged in a tree: a hot
session or a detection with very many actions is split over tasks, and no
session's log lies in one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import tables as tb
from ..session import cut_lineage, sql_over
from .compose import fold_tree

UNDOABLE = ("update", "bulk_accept", "bulk_update", "bulk_accept_global", "bulk_reject_global")
STATUS_ACTIONS = UNDOABLE

LOG_SCHEMA = ("session_id string, seq bigint, doc_id bigint, action string, det_id string, status string, "
              "action_mode string, custom_replacement string, threshold double, char_start bigint, "
              "char_end bigint, text string, type string")


# ---------------------------------------------------------------------------
# Single-table conditional projections
# ---------------------------------------------------------------------------

def bulk_accept(dets: DataFrame, threshold: float, doc_id=None) -> DataFrame:
    """Missed with confidence >= threshold becomes redacted (one document or all)."""
    cond = (F.col("status") == "missed") & (F.col("confidence") >= F.lit(threshold))
    if doc_id is not None:
        cond = cond & (F.col("doc_id") == F.lit(doc_id))
    return dets.withColumn("status", F.when(cond, F.lit("redacted")).otherwise(F.col("status")))


def bulk_reject(dets: DataFrame) -> DataFrame:
    """Missed or false_positive becomes dismissed (all documents)."""
    cond = F.col("status").isin("missed", "false_positive")
    return dets.withColumn("status", F.when(cond, F.lit("dismissed")).otherwise(F.col("status")))


def bulk_update(dets: DataFrame, status: str, doc_id=None) -> DataFrame:
    """Missed or false_positive becomes ``status`` (one document)."""
    cond = F.col("status").isin("missed", "false_positive")
    if doc_id is not None:
        cond = cond & (F.col("doc_id") == F.lit(doc_id))
    return dets.withColumn("status", F.when(cond, F.lit(status)).otherwise(F.col("status")))


def threshold_sweep(dets: DataFrame, grid: Sequence[float]) -> DataFrame:
    """How many missed items each threshold would accept, per document with detections (0 where it
    accepts none).  One aggregation, no join."""
    counts = [F.struct(F.lit(float(t)).alias("threshold"),
                       F.count_if((F.col("status") == "missed") & (F.col("confidence") >= t)).alias("would_accept")) for t in grid]
    return dets.groupBy("doc_id").agg(F.array(*counts).alias("_c")).select("doc_id", F.inline("_c"))


# ---------------------------------------------------------------------------
# Manual add, delete, upsert
# ---------------------------------------------------------------------------

def manual_detections(adds: DataFrame) -> DataFrame:
    """D3: manual additions: confidence 1.0, status redacted, source manual."""
    return adds.select(
        "doc_id", sp.det_id(F.col("doc_id"), F.col("char_start"), F.col("char_end"), F.col("type")).alias("det_id"),
        "text", "char_start", "char_end", "type", F.lit(1.0).alias("confidence"), F.lit("redacted").alias("status"),
        F.coalesce(F.col("reason"), F.lit(tb.MANUAL_REASON)).alias("reason") if "reason" in adds.columns
        else F.lit(tb.MANUAL_REASON).alias("reason"),
        F.lit("manual").alias("source"))


def delete_detections(dets: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove by id (left anti join); ids that do not exist are error rows."""
    kept = dets.join(deletes.select("det_id"), "det_id", "left_anti")
    errors = deletes.join(dets.select("det_id"), "det_id", "left_anti") \
        .withColumn("error", F.concat(F.lit("Detection "), F.col("det_id"), F.lit(" not found")))
    return kept, errors


def upsert_detections(dets: DataFrame, patches: DataFrame) -> DataFrame:
    """A patch (seq, doc_id, det_id, char_start, char_end, status, text,
    type, confidence) gives its status to the detection with the same id, else it replaces (id, text,
    type, confidence, status) the first detection with the same (start, end) in the document, else
    it is appended.  The OR condition is written as two equi joins (id,
    then span); when several patches hit one detection the latest seq wins.
    """
    ids = dets.select("det_id", F.lit(True).alias("_known"))
    by_id = patches.join(ids, "det_id", "left")
    copy = ["det_id", "text", "type", "confidence"]
    none = F.lit(None).cast("struct<det_id:string,text:string,type:string,confidence:double>")
    hit_id = by_id.filter(F.col("_known")).select("seq", F.col("det_id").alias("_tid"), "status", F.lit("id").alias("_by"), none.alias("_copy"))
    rest = by_id.filter(F.col("_known").isNull()).drop("_known")
    first_span = dets.groupBy("doc_id", "char_start", "char_end").agg(F.min("det_id").alias("_tid"))
    by_span = rest.join(first_span, ["doc_id", "char_start", "char_end"], "left")
    hit_span = by_span.filter(F.col("_tid").isNotNull()).select("seq", "_tid", "status", F.lit("span").alias("_by"),
                                                                F.struct(*copy).alias("_copy"))
    appended = by_span.filter(F.col("_tid").isNull()).select(
        "doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status",
        F.lit("appended").alias("matched_by"))
    hits = hit_id.unionByName(hit_span).groupBy("_tid").agg(
        F.max_by(F.struct("status", "_by", "_copy"), "seq").alias("_hit"))
    joined = dets.join(hits, F.col("det_id") == F.col("_tid"), "left")
    new = lambda c: F.coalesce(F.col(f"_hit._copy.{c}"), F.col(c)).alias(c)
    updated = joined.select(
        "doc_id", new("det_id"), new("text"), "char_start", "char_end", new("type"), new("confidence"),
        F.coalesce(F.col("_hit.status"), F.col("status")).alias("status"),
        F.coalesce(F.col("_hit._by"), F.lit("unchanged")).alias("matched_by"))
    return updated.unionByName(appended)


# ---------------------------------------------------------------------------
# Undo (D10) and log replay
# ---------------------------------------------------------------------------

def _undo_merge(depth: int) -> tuple[str, str]:
    """Undo as summaries of runs of actions: ``pops`` of the stack before the run, then ``keep`` of its top entries that the run's
    pushes leave in the bounded stack (the popped ones among them), the run's own entries (``tail``, the last on top), and the actions undone by the merge."""
    n, p = "size(_a.tail)", "least(_x.pops, size(_a.tail))"
    drop = f"greatest(0, {n} - _x.keep)"
    pops = f"least(_a.pops + _x.pops - {p}, _a.keep)"
    merge = (f"named_struct('pops', {pops}, 'keep', greatest({pops}, least(_a.keep, _a.pops + greatest(0, _x.keep - {n}))), "
             f"'tail', concat(slice(_a.tail, {drop} + 1, {n} - {p} - {drop}), _x.tail), 'undone', concat(_a.undone, slice(_a.tail, {n} - {p} + 1, {p}), _x.undone))")
    none = "CAST(array() AS array<bigint>)"
    return merge, f"named_struct('pops', 0, 'keep', {depth}, 'tail', {none}, 'undone', {none})"


def cancelled_actions(log: DataFrame, depth: int = tb.UNDO_DEPTH) -> DataFrame:
    """Seqs whose status effect is undone, per session.

    Undoable actions push their seq on a stack that keeps the last ``depth``; an undo pops the top; undo of an
    empty stack is a no-op; add and delete are not undoable.  Runs of a session's actions are summarized apart
    and merged in a tree, so a session may have any number of actions.
    """
    merge, zero = _undo_merge(depth)
    acts = log.filter(F.col("action").isin(*UNDOABLE, "undo") & F.col("seq").isNotNull())
    none = "CAST(array() AS array<bigint>)"
    step = F.expr(f"named_struct('pops', int(action = 'undo'), 'keep', {depth} - int(action <> 'undo'), "
                  f"'tail', CASE WHEN action = 'undo' THEN {none} ELSE array(CAST(seq AS bigint)) END, 'undone', {none})")
    _, undone = fold_tree(acts.select("session_id", F.col("seq").cast("bigint").alias("place"), step.alias("e")), ["session_id"], merge, zero, "undone")
    return undone.select("session_id", F.col("value").alias("seq"))


#: status actions as functions on the status: what missed (m), false_positive (f) and any other status (o) become (null: they stay)
_STATUS_ZERO = "named_struct('m', CAST(NULL AS string), 'f', CAST(NULL AS string), 'o', CAST(NULL AS string))"


def _after(field: str) -> str:
    """``_x`` after ``_a`` for one kind of status."""
    came = f"_a.{field}"
    on = f"CASE {came} WHEN 'missed' THEN _x.m WHEN 'false_positive' THEN _x.f ELSE _x.o END"
    return f"CASE WHEN {came} IS NULL THEN _x.{field} ELSE coalesce({on}, {came}) END"


_STATUS_MERGE = f"named_struct('m', {_after('m')}, 'f', {_after('f')}, 'o', {_after('o')})"


def replay(dets: DataFrame, log: DataFrame, doc_sessions: DataFrame) -> DataFrame:
    """Apply the corrections log to the detections.

    * a document is reviewed by one session (``doc_sessions``: doc_id, session_id; of several the first by name); actions of
      other sessions do not reach its detections, so only numbers of one session are compared;
    * manual adds are appended; the same span added again is the same detection, its latest add counts; a delete removes what is
      there at its time, so an add after it stays (neither is undoable);
    * status actions that no undo cancelled are applied in seq order, from the detection's add on (bulk actions test the status
      current at their time, session-wide ones reach all documents of the session; an update without a status leaves it);
    * action_mode and custom_replacement replay from the full log (undo restores the status only); the last non-null value wins.

    Each action reaches its detections by an equi join (detection, document or session).  A detection's actions are functions on the
    status, merged in a tree (``fold_tree``), so no detection or session is gathered in one array.
    """
    base = dets.select("doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status", "reason", "source")
    status_kinds = ", ".join(f"'{a}'" for a in STATUS_ACTIONS)
    held = sql_over(log.sparkSession, f"""
    WITH SESS AS (SELECT doc_id, min(session_id) AS session_id FROM {{sess}} GROUP BY doc_id),
    ADDS AS (SELECT doc_id, {sp.DET_ID_SQL} AS det_id, text, char_start, char_end, type, 1.0D AS confidence,
                    'redacted' AS status, {sp.sql_lit(tb.MANUAL_REASON)} AS reason, 'manual' AS source, CAST(seq AS BIGINT) AS born, session_id AS by
             FROM {{log}} WHERE action = 'add'),
    LATEST AS (SELECT x.*, s.session_id, row_number() OVER (PARTITION BY det_id ORDER BY coalesce(born, -1) DESC) AS nth
               FROM (SELECT *, CAST(NULL AS BIGINT) AS born, CAST(NULL AS string) AS by FROM {{base}} UNION ALL SELECT * FROM ADDS) x
               LEFT JOIN SESS s ON x.doc_id = s.doc_id WHERE x.by IS NULL OR x.by = s.session_id),
    GONE AS (SELECT session_id AS in_session, det_id AS gone_id, CAST(max(seq) AS BIGINT) AS last FROM {{log}} WHERE action = 'delete'
             GROUP BY session_id, det_id)
    SELECT r.doc_id, r.det_id, r.text, r.char_start, r.char_end, r.type, r.confidence, r.status, r.reason, r.source, r.born, r.session_id
    FROM LATEST r LEFT JOIN GONE g ON r.det_id = g.gone_id AND r.session_id = g.in_session
    WHERE r.nth = 1 AND (g.last IS NULL OR coalesce(r.born > g.last, false))""", base=base, log=log, sess=doc_sessions.select("doc_id", "session_id"))
    held = cut_lineage(held, "reviewed-rows")  # used four times
    said = "CASE WHEN l.action IN ('update', 'bulk_update') THEN l.status WHEN l.action = 'bulk_reject_global' THEN 'dismissed' END"
    effect = (f"CASE WHEN l.action = 'update' THEN named_struct('m', {said}, 'f', {said}, 'o', {said}) "
              "WHEN l.action IN ('bulk_accept', 'bulk_accept_global') THEN named_struct('m', CASE WHEN R.confidence >= l.threshold THEN 'redacted' END, "
              "'f', CAST(NULL AS string), 'o', CAST(NULL AS string)) "
              f"ELSE named_struct('m', {said}, 'f', {said}, 'o', CAST(NULL AS string)) END")
    pick = f"SELECT R.det_id, CAST(l.seq AS BIGINT) AS place, {effect} AS e FROM {{held}} R JOIN LIVE l ON"
    later = "l.seq > coalesce(R.born, l.seq - 1)"
    steps = sql_over(log.sparkSession, f"""
    WITH LIVE AS (SELECT DISTINCT l.session_id, l.seq, l.doc_id, l.action, l.det_id, l.status, l.threshold FROM {{log}} l
                  LEFT ANTI JOIN {{undone}} c ON l.session_id = c.session_id AND l.seq = c.seq WHERE l.action IN ({status_kinds}))
    {pick} l.det_id = R.det_id AND l.session_id = R.session_id AND l.action = 'update' AND {later}
    UNION ALL {pick} l.doc_id = R.doc_id AND l.session_id = R.session_id AND l.action IN ('bulk_accept', 'bulk_update') AND {later}
    UNION ALL {pick} l.session_id = R.session_id AND l.action IN ('bulk_accept_global', 'bulk_reject_global') AND {later}""",
                     held=held, log=log, undone=cancelled_actions(log))
    steps = cut_lineage(steps, "steps")  # used twice; its long plan is planned once
    folded, _ = fold_tree(steps, ["det_id"], _STATUS_MERGE, _STATUS_ZERO)
    return sql_over(log.sparkSession, """
    WITH MODES AS (SELECT session_id, det_id, max_by(action_mode, CASE WHEN action_mode IS NOT NULL THEN seq END) AS action_mode,
                          max_by(custom_replacement, CASE WHEN custom_replacement IS NOT NULL THEN seq END) AS custom_replacement
                   FROM {log} WHERE action = 'update' GROUP BY session_id, det_id)
    SELECT R.det_id, R.doc_id, R.text, R.char_start, R.char_end, R.type, R.confidence,
           coalesce(CASE R.status WHEN 'missed' THEN a.e.m WHEN 'false_positive' THEN a.e.f ELSE a.e.o END, R.status) AS status, R.reason,
           R.source, R.session_id, R.status AS status_before_review, m.action_mode, m.custom_replacement
    FROM {held} R LEFT JOIN {folded} a ON R.det_id = a.det_id LEFT JOIN MODES m ON R.det_id = m.det_id AND R.session_id = m.session_id""",
                    held=held, folded=folded, log=log)


def correction_errors(dets: DataFrame, log: DataFrame) -> DataFrame:
    """Update and delete actions whose detection does not exist."""
    known = dets.select("det_id")
    acts = log.filter(F.col("action").isin("update", "delete"))
    return acts.join(known, "det_id", "left_anti").select(
        "session_id", "seq", "action", "det_id",
        F.concat(F.lit("Detection "), F.col("det_id"), F.lit(" not found")).alias("error"))


# ---------------------------------------------------------------------------
# Triage order
# ---------------------------------------------------------------------------

def triage_order(dets: DataFrame) -> DataFrame:
    """Items needing attention: missed first by confidence descending,
    then false_positive by confidence ascending; ``triage_rank`` per document."""
    att = dets.filter(F.col("status").isin("missed", "false_positive"))
    key = F.when(F.col("status") == "missed", -F.col("confidence")).otherwise(F.col("confidence"))
    w = Window.partitionBy("doc_id").orderBy((F.col("status") != "missed").cast("int"), key,
                                             F.col("char_start"), F.col("det_id"))
    return att.withColumn("triage_rank", F.row_number().over(w))


def triage_top(dets: DataFrame, k: int = tb.TRIAGE_TOP) -> DataFrame:
    """First k triage items per document and the '+N more' count."""
    t = triage_order(dets)
    t = t.withColumn("n_attention", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return t.filter(F.col("triage_rank") <= k).withColumn(
        "more", F.greatest(F.col("n_attention") - k, F.lit(0)))


def triage_neighbours(dets: DataFrame) -> DataFrame:
    """Cyclic next / previous item in triage order."""
    t = triage_order(dets)
    w = Window.partitionBy("doc_id").orderBy("triage_rank")
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.select(
        "doc_id", "det_id", "triage_rank",
        F.coalesce(F.lead("det_id").over(w), F.first("det_id").over(wall)).alias("next_det_id"),
        F.coalesce(F.lag("det_id").over(w), F.last("det_id").over(wall)).alias("prev_det_id"))


def status_transitions(replayed: DataFrame) -> DataFrame:
    """Previous status vs new status counts."""
    return replayed.groupBy(F.col("status_before_review").alias("previous_status"),
                            F.col("status").alias("new_status")).agg(F.count(F.lit(1)).alias("n"))
