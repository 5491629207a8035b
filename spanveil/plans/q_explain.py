"""Registered explanation and text-structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import detect as dt
from ..operators import explain as ex
from ..operators import structure as st
from ..session import read_table
from . import common as cm
from . import sqlkit as sk
from .registry import register

_WORDS_SQL = """WX AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws, string_split_regex(text, '\\S+') AS gs FROM documents),
  WU AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM WX),
  WT AS (SELECT doc_id, i, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS char_end
         FROM WU),
  W AS MATERIALIZED (SELECT doc_id, CAST(i AS INTEGER) AS word_idx, CAST(char_end - length(word) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, word
        FROM WT)"""


@register("word_table", f"WITH {_WORDS_SQL} SELECT * FROM W")
def word_table(spark, sf_dir):
    """Every whitespace-delimited word with its offsets."""
    return st.word_table(cm.documents(spark, sf_dir))


def _low(w: str) -> str:
    return f"lower(regexp_replace({w}, '^\\s+|\\s+$', '', 'g'))"


def _rule_sql(w: str) -> str:
    low = _low(w)
    fw = ", ".join(sk.q(x) for x in tb.FUNCTION_WORDS)
    return f"""(CASE WHEN length({low}) <= 2 THEN 'short'
                 WHEN regexp_matches({low}, {sk.q('|'.join(tb.LEGAL_TERMS))}) THEN 'legal'
                 WHEN {low} IN ({fw}) THEN 'function'
                 WHEN regexp_matches({low}, '^[0-9]+$') AND length({low}) <= 4 THEN 'number'
                 ELSE 'default' END)"""


def _unflagged_text_sql(w: str, rule: str) -> str:
    n = f"CAST(length({_low(w)}) AS VARCHAR)"
    return f"""(CASE {rule} WHEN 'short' THEN {sk.fill_sql(tb.EXPLAIN_SHORT, t=w)}
                 WHEN 'legal' THEN {sk.fill_sql(tb.EXPLAIN_LEGAL, t=w)}
                 WHEN 'function' THEN {sk.fill_sql(tb.EXPLAIN_FUNCTION, t=w)}
                 WHEN 'number' THEN {sk.fill_sql(tb.EXPLAIN_NUMBER, t=w, n=n)}
                 ELSE {sk.fill_sql(tb.EXPLAIN_DEFAULT, t=w)} END)"""


_EXPLAIN_SQL = f"""WITH {sk.pipeline_sql()}, {_WORDS_SQL},
    FO AS (SELECT w.doc_id, w.word_idx, arg_min(d.det_id, (d.char_start, d.det_id)) AS det_id,
                  arg_min(d.type, (d.char_start, d.det_id)) AS d_type, arg_min(d.confidence, (d.char_start, d.det_id)) AS d_conf,
                  arg_min(d.reason, (d.char_start, d.det_id)) AS d_reason
           FROM W w JOIN DET d ON w.doc_id = d.doc_id AND w.char_start < d.char_end AND w.char_end > d.char_start
           GROUP BY w.doc_id, w.word_idx),
    EW AS (SELECT w.*, fo.det_id, fo.d_type, fo.d_conf, fo.d_reason, {_rule_sql('w.word')} AS r FROM W w
           LEFT JOIN FO fo ON fo.doc_id = w.doc_id AND fo.word_idx = w.word_idx),
    EXW AS (SELECT doc_id, word_idx, char_start, char_end, word, det_id IS NOT NULL AS is_detection, det_id,
                   CASE WHEN det_id IS NOT NULL THEN 'cached' ELSE 'rules' END AS source,
                   CASE WHEN det_id IS NOT NULL THEN 'detection' ELSE r END AS rule,
                   CASE WHEN det_id IS NOT NULL THEN (CASE WHEN d_conf >= 0.85 THEN 'high' WHEN d_conf >= 0.5 THEN 'medium' ELSE 'low' END)
                        WHEN r = 'number' THEN 'low' ELSE 'none' END AS risk_level,
                   CASE WHEN det_id IS NOT NULL THEN coalesce(d_reason, 'Detected as ' || coalesce(d_type, 'UNKNOWN') || ' with ' || {sk.pct_sql('coalesce(d_conf, 0.0)')} || ' confidence.')
                        ELSE {_unflagged_text_sql('word', 'r')} END AS explanation
            FROM EW)"""


@register("explain_words", f"{_EXPLAIN_SQL} SELECT * FROM EXW")
def explain_words(spark, sf_dir):
    """E1+E2+E4+E5: every word explained: flagged words from the cached
    detection, the rest by the rule cascade."""
    return ex.explain_words(_words(spark, sf_dir))


def _words(spark, sf_dir, external=None):
    return st.words_with_detections(dt.detect_arrays(cm.documents_with_policy(spark, sf_dir)), external=external)


@register("explain_external", f"""{_EXPLAIN_SQL}
    SELECT * REPLACE (CASE WHEN source = 'rules' AND word_idx % 7 = 0 THEN 'model' ELSE source END AS source,
                      CASE WHEN source = 'rules' AND word_idx % 7 = 0 THEN 'external' ELSE rule END AS rule,
                      CASE WHEN source = 'rules' AND word_idx % 7 = 0 THEN 'medium' ELSE risk_level END AS risk_level,
                      CASE WHEN source = 'rules' AND word_idx % 7 = 0 THEN 'The model on "' || word || '".' ELSE explanation END AS explanation)
    FROM EXW""")
def explain_external(spark, sf_dir):
    """E5: the cascade with a table of external explanations (here of every seventh word): a stored detection comes
    first, then the external text, then the rules."""
    external = st.word_table(cm.documents(spark, sf_dir)).filter("word_idx % 7 = 0").select(
        "doc_id", "word_idx", F.concat(F.lit('The model on "'), "word", F.lit('".')).alias("explanation"),
        F.lit("medium").alias("risk_level"), F.lit("model").alias("source"))
    return ex.explain_words(_words(spark, sf_dir, external))


@register("explain_unflagged", f"""{_EXPLAIN_SQL}
    SELECT rule, risk_level, count(*) AS n_words, count(DISTINCT lower(word)) AS n_distinct
    FROM EXW WHERE NOT is_detection GROUP BY rule, risk_level""")
def explain_unflagged(spark, sf_dir):
    """How the rule cascade classifies every unflagged word."""
    e = ex.explain_words(_words(spark, sf_dir)).filter(~F.col("is_detection"))
    return e.groupBy("rule", "risk_level").agg(F.count(F.lit(1)).alias("n_words"),
                                               F.countDistinct(F.lower("word")).alias("n_distinct"))


def _flagged_sql() -> str:
    desc = f"coalesce({sk.case_map_sql(tb.PII_DESCRIPTIONS, 'type')}, 'data classified as ' || type)"
    has = "(confidence IS NOT NULL AND confidence <> 0)"
    pct = f"(CASE WHEN {has} THEN {sk.pct_sql('confidence')} ELSE 'unknown' END)"
    note = f"""(CASE WHEN {has} AND confidence >= 0.85 THEN {sk.fill_sql(tb.CONF_NOTE_HIGH, pct=pct)}
                   WHEN {has} AND confidence >= 0.5 THEN {sk.fill_sql(tb.CONF_NOTE_MEDIUM, pct=pct)}
                   ELSE {sk.fill_sql(tb.CONF_NOTE_LOW, pct=pct)} END)"""
    base = f"""('"' || text || '" was identified as ' || {desc} || '. ' || {note})"""
    return f"""CASE WHEN length(coalesce(reason, '')) > 0 THEN {base} || ' Detection basis: ' || reason ELSE {base} END"""


@register("explain_flagged", f"""WITH {sk.pipeline_sql()}
    SELECT doc_id, det_id, {_flagged_sql()} AS explanation,
           CASE WHEN coalesce(confidence, 0) >= 0.85 THEN 'high' WHEN coalesce(confidence, 0) >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level
    FROM DET""")
def explain_flagged(spark, sf_dir):
    """Rule explanation of each flagged text (description, confidence
    note, detection basis)."""
    from ..functions import spans as sp
    d = cm.detections(spark, sf_dir)
    return d.select("doc_id", "det_id", ex.flagged_explanation(F.col("text"), F.col("type"), F.col("confidence"),
                                                              F.col("reason")).alias("explanation"),
                    sp.risk_level(F.col("confidence")).alias("risk_level"))


@register("risk_levels", f"""WITH {sk.pipeline_sql()}
    SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level,
           type, count(*) AS n FROM DET GROUP BY ALL""")
def risk_levels(spark, sf_dir):
    """Detections per risk band and type."""
    from ..functions import spans as sp
    d = cm.detections(spark, sf_dir)
    return d.groupBy(sp.risk_level(F.col("confidence")).alias("risk_level"), "type").agg(F.count(F.lit(1)).alias("n"))


@register("context_window", f"""WITH {sk.pipeline_sql()}
    SELECT x.doc_id, x.det_id, CAST(greatest(x.char_start - 200, 0) AS BIGINT) AS ctx_start,
           CAST(least(x.char_end + 200, length(d.text)) AS BIGINT) AS ctx_end,
           substr(d.text, CAST(greatest(x.char_start - 200, 0) AS INTEGER) + 1,
                  CAST(least(x.char_end + 200, length(d.text)) - greatest(x.char_start - 200, 0) AS INTEGER)) AS context
    FROM DET x JOIN documents d ON d.doc_id = x.doc_id""")
def context_window(spark, sf_dir):
    """200 characters around each detection, clipped to the document."""
    d = cm.detections(spark, sf_dir).select("doc_id", "det_id", "char_start", "char_end")
    return st.context_window(cm.documents(spark, sf_dir), d, tb.CONTEXT_RADIUS).select(
        "doc_id", "det_id", "ctx_start", "ctx_end", "context")


@register("mark_selection", f"""WITH {sk.pipeline_sql()}
    SELECT x.doc_id, x.det_id, CAST(instr(d.text, x.text) - 1 AS BIGINT) AS first_pos,
           CAST(instr(d.text, x.text) - 1 AS BIGINT) = x.char_start AS at_detection
    FROM DET x JOIN documents d ON d.doc_id = x.doc_id""")
def mark_selection(spark, sf_dir):
    """A manual mark lands at the first literal occurrence of the
    selected text (which need not be where the reviewer selected it)."""
    d = cm.detections(spark, sf_dir).select("doc_id", "det_id", "char_start", F.col("text").alias("sel"))
    j = d.join(cm.documents(spark, sf_dir), "doc_id")
    pos = st.first_occurrence(F.col("text"), F.col("sel")).cast("bigint")
    return j.select("doc_id", "det_id", pos.alias("first_pos"), (pos == F.col("char_start")).alias("at_detection"))


_QUERY_SQL = "SELECT doc_id, regexp_extract(text, '[A-Za-z]{6,}', 0) AS query FROM documents WHERE length(regexp_extract(text, '[A-Za-z]{6,}', 0)) > 0"


@register("search_highlight", f"""WITH Q AS ({_QUERY_SQL}),
    S AS (SELECT q.doc_id, q.query, d.text FROM Q q JOIN documents d ON d.doc_id = q.doc_id)
    SELECT s.doc_id, s.query, CAST(x.match_idx AS INTEGER) AS match_idx, CAST(x.s AS BIGINT) AS char_start,
           CAST(x.e AS BIGINT) AS char_end, x.m AS match
    FROM ({sk.spans_sql("SELECT doc_id, text, query FROM S", "__P__")}) x JOIN S s ON s.doc_id = x.doc_id""".replace(
    "'__P__'", "'(?i)\\Q' || query || '\\E'"))
def search_highlight(spark, sf_dir):
    """All case-insensitive occurrences of each document's search
    string (its first word of six or more letters)."""
    docs = cm.documents(spark, sf_dir)
    qs = docs.select("doc_id", F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("query")).filter(F.length("query") > 0)
    return st.search_highlight(docs, qs)


@register("search_words", f"""WITH Q AS ({_QUERY_SQL}), {_WORDS_SQL}
    SELECT w.doc_id, q.query, CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.char_start) - 1 AS INTEGER) AS match_idx,
           w.char_start, w.char_end, w.word AS match
    FROM W w JOIN Q q ON q.doc_id = w.doc_id AND lower(q.query) = lower(w.word)""")
def search_words(spark, sf_dir):
    """The words equal to each document's search string, ignoring case."""
    docs = cm.documents(spark, sf_dir)
    qs = docs.select("doc_id", F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("query")).filter(F.length("query") > 0)
    return st.search_highlight(docs, qs, whole_words=True)


@register("segments", f"""WITH {sk.pipeline_sql()},
    SG AS (SELECT doc_id, char_start, char_end, det_id,
                  coalesce(lag(char_end) OVER (PARTITION BY doc_id ORDER BY char_start), 0) AS prev FROM DET),
    PIECES AS (
      SELECT doc_id, char_start AS k, 0 AS sub, 'plain' AS kind, prev AS s, char_start AS e, NULL AS det_id FROM SG
      UNION ALL SELECT doc_id, char_start, 1, 'detection', char_start, char_end, det_id FROM SG
      UNION ALL SELECT d.doc_id, 9223372036854775807, 2, 'plain', coalesce(m.last_e, 0), length(d.text), NULL
      FROM documents d LEFT JOIN (SELECT doc_id, max(char_end) AS last_e FROM DET GROUP BY doc_id) m ON m.doc_id = d.doc_id)
    SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY k, sub) - 1 AS INTEGER) AS seg_idx, kind,
           CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end, det_id,
           substr(d.text, CAST(s AS INTEGER) + 1, CAST(e - s AS INTEGER)) AS text
    FROM PIECES p JOIN documents d ON d.doc_id = p.doc_id WHERE e > s""")
def segments(spark, sf_dir):
    """Documents as alternating plain and detection segments."""
    return st.segments(cm.documents(spark, sf_dir), cm.detections(spark, sf_dir))


_NODES_SQL = """ND AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS node_ord, role, text,
                  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
           FROM conversations),
    NODES AS (SELECT *, char_start + length(text) AS char_end FROM ND),
    CDOC AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def _nodes(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    nodes = conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("node_ord"), "role", "text")
    return st.assemble_nodes(nodes)


@register("assemble_nodes", f"""WITH {_NODES_SQL}
    SELECT n.doc_id, n.node_ord, n.char_start, n.char_end, substr(c.text, CAST(n.char_start AS INTEGER) + 1,
           CAST(n.char_end - n.char_start AS INTEGER)) = n.text AS consistent, length(c.text) AS doc_len
    FROM NODES n JOIN CDOC c ON c.doc_id = n.doc_id""")
def assemble_nodes(spark, sf_dir):
    """Conversation turns as nodes of one text; node offsets agree with the assembled text."""
    placed, docs = _nodes(spark, sf_dir)
    j = placed.join(docs.withColumnRenamed("text", "doc"), "doc_id")
    return j.select("doc_id", "node_ord", "char_start", "char_end",
                    (F.col("doc").substr(F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
                     == F.col("text")).alias("consistent"), F.length("doc").cast("bigint").alias("doc_len"))


_CROSS = r"[a-z]+\.\n[A-Z][a-z]+"


@register("span_to_node", f"""WITH {_NODES_SQL},
    SP AS (SELECT doc_id, CAST(match_idx AS INTEGER) AS span_idx, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end
           FROM ({sk.spans_sql('SELECT doc_id, text FROM CDOC', _CROSS)}))
    SELECT sp.doc_id, sp.span_idx, sp.char_start, sp.char_end, n.node_ord,
           greatest(sp.char_start, n.char_start) - n.char_start AS local_start,
           least(sp.char_end, n.char_end) - n.char_start AS local_end
    FROM SP sp JOIN NODES n ON n.doc_id = sp.doc_id AND n.char_start < sp.char_end AND n.char_end > sp.char_start""")
def span_to_node(spark, sf_dir):
    """Spans over assembled conversations mapped to the turns they touch,
    with offsets inside each turn (spans here cross turn boundaries)."""
    placed, docs = _nodes(spark, sf_dir)
    spans = dt.pattern_spans(docs, [("cross", _CROSS, "CROSS", 0.0, "")]).select(
        "doc_id", F.col("match_idx").cast("int").alias("span_idx"), "char_start", "char_end")
    m = st.span_to_node(spans, placed)
    return m.select("doc_id", "span_idx", "char_start", "char_end", "node_ord", "local_start", "local_end")
