"""DuckDB SQL fragments used by the oracle queries.

The oracle is an independent formulation of each query in plain SQL, run by
DuckDB on the same parquet tables.  RE2 (DuckDB's regex engine) has no
lookaround, so look-around patterns get an equivalent digit-run form here.
"""

from __future__ import annotations

from ..functions import tables as tb


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def spans_sql(src: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """SELECT doc_id, match_idx (0-based), s, e, m: every leftmost
    non-overlapping match of ``pattern`` with code-point offsets.

    Offsets come from the gaps (``string_split_regex``) and the matches
    (``regexp_extract_all``): start of match i = length of all earlier gaps
    and matches.
    """
    p = q(pattern)
    return f"""
    SELECT {id_col} AS doc_id, i - 1 AS match_idx,
           length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i-1], '')) AS s,
           length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i], '')) AS e,
           ms[i] AS m
    FROM (SELECT {id_col}, ms, gs, unnest(generate_series(1, len(ms))) AS i
          FROM (SELECT {id_col}, regexp_extract_all({text_col}, {p}) AS ms,
                       string_split_regex({text_col}, {p}) AS gs
                FROM ({src}) WHERE regexp_matches({text_col}, {p})))
    """


# RE2 form of the Indian mobile pattern: maximal digit runs with an optional
# "+91" and one separator in front; kept when the run has exactly 10 digits
# and starts with 6-9 (equivalent to the look-around form).
PHONE_RUN = r"(?:\+91[ \t\n\x0B\f\r-])?[0-9]+"


def phone_spans_sql(src: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    inner = spans_sql(src, PHONE_RUN, id_col, text_col)
    return f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS match_idx, s, e, m
    FROM ({inner})
    WHERE length(regexp_extract(m, '[0-9]+$')) = 10 AND substr(regexp_extract(m, '[0-9]+$'), 1, 1) IN ('6','7','8','9')
    """


def pattern_spans_sql(src: str, patterns=tb.HEURISTIC_PATTERNS, id_col: str = "doc_id",
                      text_col: str = "text") -> str:
    """Union over the pattern pack: doc_id, pat_idx, match_idx, s, e, m, type, conf, reason."""
    parts = []
    for i, (name, regex, ptype, conf, reason) in enumerate(patterns):
        body = phone_spans_sql(src, id_col, text_col) if "(?<!" in regex else spans_sql(src, regex, id_col, text_col)
        parts.append(f"""SELECT doc_id, {i} AS pat_idx, match_idx, s, e, m, {q(ptype)} AS type,
                         CAST({conf} AS DOUBLE) AS conf, {q(reason)} AS reason
                         FROM ({body}) WHERE length(trim(m)) >= {tb.HEURISTIC_MIN_TRIMMED_LENGTH}""")
    return "\nUNION ALL\n".join(parts)


def heuristic_sql(src: str = "SELECT doc_id, text FROM documents") -> str:
    """Heuristic detections with bands and reasons (no det_id)."""
    return f"""
    SELECT doc_id, pat_idx * 4294967296 + match_idx AS h_rank, m AS text,
           CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end, type, conf AS confidence,
           CASE WHEN conf >= 0.85 THEN 'redacted' WHEN conf >= 0.5 THEN 'missed' ELSE 'false_positive' END AS status,
           {q(tb.HEURISTIC_REASON_PREFIX)} || reason AS reason, 'heuristic' AS source
    FROM ({pattern_spans_sql(src)})
    """


def det_id_sql(doc="doc_id", s="char_start", e="char_end", t="type") -> str:
    return f"substr(sha256(concat_ws('|', CAST({doc} AS VARCHAR), CAST({s} AS VARCHAR), CAST({e} AS VARCHAR), {t})), 1, 16)"


def standin_sql(src: str = "SELECT doc_id, text FROM documents") -> str:
    pats = [(label, regex, label, 0.0, "") for label, regex in tb.STANDIN_ENTITY_PATTERNS]
    return f"""
    SELECT doc_id, type AS label, m AS text, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end,
           CAST(round(0.40 + ((doc_id * 37 + s) % 60) / 100.0, 2) AS DOUBLE) AS score
    FROM ({pattern_spans_sql(src, pats)})
    """


def policies_sql() -> str:
    rows = []
    for name, (labels, thr, rule) in tb.POLICIES.items():
        lab = "[" + ", ".join(q(x) for x in labels) + "]"
        rows.append(f"({q(name)}, {lab}, CAST({thr} AS DOUBLE), {q(rule)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS p(policy, labels, threshold, rule)"


def doc_policy_sql() -> str:
    """Per-document policy derived from doc_id (index 8 is an unknown name)."""
    names = tb.POLICY_NAMES + ["unknown_policy"]
    arr = "[" + ", ".join(q(n) for n in names) + "]"
    return f"SELECT doc_id, {arr}[CAST(doc_id % {len(names)} AS INTEGER) + 1] AS policy FROM documents"


def pct_sql(conf: str) -> str:
    return f"CAST(CAST(round_even({conf} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


def fill_sql(template: str, **vals) -> str:
    out = q(template)
    for k, v in vals.items():
        out = f"replace({out}, {q('{' + k + '}')}, {v})"
    return out


def model_reason_sql(label: str, conf: str, policy: str) -> str:
    up = f"upper({label})"
    shown = f"replace({up}, '_', ' ')"
    pct = pct_sql(conf)
    return f"""CASE WHEN contains({up}, 'PERSON') OR contains({up}, 'NAME') THEN {fill_sql(tb.MODEL_REASON_PERSON, label=shown, pct=pct, policy=policy)}
         WHEN contains({up}, 'IBAN') OR contains({up}, 'ACCOUNT') OR contains({up}, 'CARD') THEN {fill_sql(tb.MODEL_REASON_FINANCIAL, label=shown, pct=pct)}
         WHEN contains({up}, 'PASSWORD') OR contains({up}, 'KEY') OR contains({up}, 'TOKEN') THEN {fill_sql(tb.MODEL_REASON_SECRET, label=shown)}
         ELSE {fill_sql(tb.MODEL_REASON_DEFAULT, label=shown, pct=pct, policy=policy)} END"""


def model_sql() -> str:
    """Policy-filtered model detections over the stand-in raw entities."""
    return f"""
    SELECT r.doc_id, r.text, r.char_start, r.char_end, upper(r.label) AS type,
           round(r.score, 2) AS confidence,
           CASE WHEN round(r.score, 2) >= 0.85 THEN 'redacted' ELSE 'missed' END AS status,
           {model_reason_sql('r.label', 'round(r.score, 2)', 'd.policy')} AS reason,
           {q(tb.MODEL_SOURCE)} AS source, d.policy, p.rule
    FROM ({standin_sql()}) r
    JOIN ({doc_policy_sql()}) d ON r.doc_id = d.doc_id
    JOIN ({policies_sql()}) p ON p.policy = CASE WHEN d.policy IN (SELECT policy FROM ({policies_sql()})) THEN d.policy ELSE {q(tb.DEFAULT_POLICY)} END
    WHERE list_contains(p.labels, r.label) AND r.score >= p.threshold
    """


PUNCT_SQL = "(" + ", ".join(q(x) for x in tb.TRAILING_PUNCTUATION) + ")"


def merged_sql() -> str:
    """C12 in SQL: model spans M, heuristic spans H, merged list MG (grp, ord)."""
    return f"""
    M AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, type, text) AS m_ord
          FROM ({model_sql()})),
    H AS ({heuristic_sql()}),
    P AS (SELECT h.doc_id, h.h_rank, h.char_start AS hs, h.char_end AS he, h.confidence AS hc, h.status AS hst,
                 m.m_ord, m.confidence AS mc
          FROM H h JOIN M m ON h.doc_id = m.doc_id AND h.char_start < m.char_end AND m.char_start < h.char_end
          QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.h_rank ORDER BY m.m_ord) = 1),
    P2 AS (SELECT *, hc > greatest(mc, coalesce(max(hc) OVER (PARTITION BY doc_id, m_ord ORDER BY h_rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), mc)) AS rz FROM P),
    PM AS (SELECT doc_id, m_ord, min(hs) AS hmin, max(he) AS hmax, max(hc) AS hcmax,
                  sum(CASE WHEN rz THEN 1 ELSE 0 END) AS nr, bool_or(rz AND hst = 'redacted') AS pr
           FROM P2 GROUP BY doc_id, m_ord),
    MG AS (
      SELECT m.doc_id,
             CASE WHEN pm.hmin IS NULL THEN m.char_start ELSE least(m.char_start, pm.hmin) END AS char_start,
             CASE WHEN pm.hmin IS NULL THEN m.char_end ELSE greatest(m.char_end, pm.hmax) END AS char_end,
             m.type,
             CASE WHEN pm.hmin IS NULL THEN m.confidence ELSE greatest(m.confidence, pm.hcmax) END AS confidence,
             CASE WHEN coalesce(pm.pr, false) THEN 'redacted' ELSE m.status END AS status,
             m.reason || repeat({q(tb.MERGE_REASON_SUFFIX)}, CAST(coalesce(pm.nr, 0) AS INTEGER)) AS reason,
             CASE WHEN pm.hmin IS NULL THEN m.source ELSE 'dual' END AS source,
             m.policy, m.rule, 0 AS grp, CAST(m.m_ord AS BIGINT) AS ord
      FROM M m LEFT JOIN PM pm ON m.doc_id = pm.doc_id AND m.m_ord = pm.m_ord
      UNION ALL
      SELECT h.doc_id, h.char_start, h.char_end, h.type, h.confidence, h.status, h.reason, h.source,
             NULL, NULL, 1, h.h_rank
      FROM H h WHERE NOT EXISTS (SELECT 1 FROM P WHERE P.doc_id = h.doc_id AND P.h_rank = h.h_rank))
    """


def aligned_sql(src_cte: str = "MG") -> str:
    """C13 in SQL over CTE ``src_cte``: adds pre_start, re-bounds, re-cut text (CTE AL)."""
    tok_src = "SELECT k, region FROM A2"
    return f"""
    A1 AS (SELECT x.*, row_number() OVER () AS k, d.text AS doc,
                  x.char_start - length(regexp_extract(substr(d.text, 1, CAST(x.char_start AS INTEGER)), '\\S*$')) AS L,
                  x.char_end + length(regexp_extract(substr(d.text, CAST(x.char_end AS INTEGER) + 1), '^\\S*')) AS R
           FROM {src_cte} x JOIN documents d ON x.doc_id = d.doc_id),
    A2 AS (SELECT k, L, substr(doc, CAST(L AS INTEGER) + 1, CAST(R - L AS INTEGER)) AS region FROM A1),
    TF AS (SELECT a.k, t.s + a.L AS ts, t.e + a.L AS te, t.m
           FROM ({spans_sql(tok_src, tb.TOKEN_PATTERN, 'k', 'region')}) t JOIN A1 a ON a.k = t.doc_id
           WHERE t.s + a.L < a.char_end AND t.e + a.L > a.char_start),
    TA AS (SELECT k, list(struct_pack(s := ts, e := te, m := m) ORDER BY ts) AS tl FROM TF GROUP BY k),
    TB AS (SELECT k, CASE WHEN len(tl) > 1 AND tl[-1].m IN {PUNCT_SQL} THEN tl[1:len(tl) - 1] ELSE tl END AS tl FROM TA),
    AL0 AS (SELECT a.* EXCLUDE (k, L, R),
                   a.char_start AS pre_start,
                   CAST(CASE WHEN tb.tl IS NULL THEN a.char_start ELSE tb.tl[1].s END AS BIGINT) AS ns,
                   CAST(CASE WHEN tb.tl IS NULL THEN a.char_end ELSE tb.tl[-1].e END AS BIGINT) AS ne
            FROM A1 a LEFT JOIN TB tb ON a.k = tb.k),
    AL AS (SELECT * EXCLUDE (char_start, char_end, ns, ne, doc), ns AS char_start, ne AS char_end,
                  substr(doc, CAST(ns AS INTEGER) + 1, CAST(ne - ns AS INTEGER)) AS text, doc FROM AL0)
    """


def islands_sql(src_cte: str, order: str) -> str:
    """C14 in SQL over CTE ``src_cte`` (must have doc text column ``doc``): CTE FI."""
    return f"""
    I0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, {order}) AS rn,
                  max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, {order}
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
           FROM {src_cte}),
    I1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR char_start >= pe THEN 1 ELSE 0 END)
                      OVER (PARTITION BY doc_id ORDER BY char_start, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
           FROM I0),
    FI AS (SELECT doc_id, min(char_start) AS char_start, max(char_end) AS char_end, max(confidence) AS confidence,
                  first(type ORDER BY confidence DESC, rn) AS type, first(status ORDER BY rn) AS status,
                  first(reason ORDER BY rn) AS reason, first(source ORDER BY rn) AS source,
                  first(policy ORDER BY rn) AS policy, first(rule ORDER BY rn) AS rule,
                  substr(first(doc), CAST(min(char_start) AS INTEGER) + 1, CAST(max(char_end) - min(char_start) AS INTEGER)) AS text
           FROM I1 GROUP BY doc_id, isl)
    """


def pipeline_sql() -> str:
    """Full detection pipeline (C17) as CTEs, final CTE ``DET``."""
    return f"""
    {merged_sql()},
    {aligned_sql('MG')},
    {islands_sql('AL', 'pre_start, grp, ord')},
    DET AS (SELECT doc_id, {det_id_sql()} AS det_id, text, char_start, char_end, type, confidence, status, reason,
                   source, policy, rule FROM FI)
    """


def case_map_sql(mapping: dict, key: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {key} {whens} END)"


def initcap_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def anon_label_sql(t: str) -> str:
    clean = f"replace(regexp_replace({t}, '^(US|IN|UK|AU|CA|EU|SG)_', '', 'i'), '_', ' ')"
    return f"coalesce({case_map_sql(tb.ANONYMIZED_REPLACEMENTS, t)}, '[' || {initcap_sql(clean)} || ']')"


def block_sql(text: str) -> str:
    return f"repeat({q(tb.BLOCK_CHAR)}, greatest(length({text}), {tb.MIN_BLOCK}))"


def mode_sql(am: str, gm: str) -> str:
    return (f"(CASE WHEN {am} = 'highlight_red' THEN 'highlight_red' WHEN {gm} = 'highlight' THEN 'highlight' "
            f"WHEN {am} IN ('redact', 'anonymize') THEN {am} ELSE {gm} END)")


def replacement_sql(text: str, t: str, am: str, custom: str, gm: str) -> str:
    c = f"regexp_replace({custom}, '^\\s+|\\s+$', '', 'g')"
    m = mode_sql(am, gm)
    return f"""(CASE WHEN length({c}) > 0 THEN {c}
                 WHEN {m} IN ('highlight_red', 'highlight') THEN {text}
                 WHEN {m} = 'anonymize' THEN {anon_label_sql(t)}
                 ELSE {block_sql(text)} END)"""


def rewrite_sql(spans_cte: str) -> str:
    """Documents with their spans (doc_id, char_start, char_end, rep) rewritten; of overlapping ones the first stands for all."""
    order = "PARTITION BY doc_id ORDER BY char_start, char_end DESC, rep"
    return f"""
    SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text ELSE g.body || substr(d.text, CAST(g.last_e AS INTEGER) + 1) END AS text
    FROM documents d LEFT JOIN (
      SELECT r.doc_id, string_agg(CASE WHEN r.char_start >= r.prev THEN
                 substr(d2.text, CAST(r.prev AS INTEGER) + 1, CAST(r.char_start - r.prev AS INTEGER)) || r.rep ELSE '' END, '' ORDER BY r.n) AS body,
             max(r.char_end) AS last_e
      FROM (SELECT *, row_number() OVER ({order}) AS n,
                   coalesce(max(char_end) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM {spans_cte}) r
      JOIN documents d2 ON d2.doc_id = r.doc_id GROUP BY r.doc_id) g ON g.doc_id = d.doc_id
    """
