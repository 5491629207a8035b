"""Registered redaction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables as tb
from ..operators import detect as dt
from ..operators import redact as rd
from ..session import read_table
from . import common as cm
from . import sqlkit as sk
from .registry import register

_DET = f"WITH {sk.pipeline_sql()}"
_DETM = f"""{_DET}, DM AS (SELECT *, {cm.MODES_SQL} FROM DET)"""


@register("replacement_text", f"""{_DETM}
    SELECT doc_id, det_id, action_mode, custom_replacement, global_mode,
           {sk.replacement_sql('text', 'type', 'action_mode', 'custom_replacement', 'global_mode')} AS rep
    FROM DM""")
def replacement_text(spark, sf_dir):
    """replacement order custom > highlight_red > highlight > anonymize label > block."""
    d = cm.with_review_modes(cm.detections(spark, sf_dir))
    return d.select("doc_id", "det_id", "action_mode", "custom_replacement", "global_mode",
                    rd.replacement_text(F.col("text"), F.col("type"), F.col("action_mode"),
                                        F.col("custom_replacement"), F.col("global_mode")).alias("rep"))


def _redact(spark, sf_dir, mode: str):
    none = F.lit(None).cast("string")
    return rd.redact_detected(dt.detect_arrays(cm.documents_with_policy(spark, sf_dir)),
                              lambda x: rd.replacement_text(x["text"], x["type"], none, none, F.lit(mode)))


def _redact_sql(mode: str) -> str:
    rep = sk.replacement_sql("text", "type", "NULL", "NULL", sk.q(mode))
    return f"""{_DET}, RS AS (SELECT doc_id, char_start, char_end, {rep} AS rep FROM DET WHERE status IN ('redacted', 'added'))
    {sk.rewrite_sql('RS')}"""


@register("redact_documents", _redact_sql("redact"))
def redact_documents(spark, sf_dir):
    """every document with its confirmed spans blacked out."""
    return _redact(spark, sf_dir, "redact")


@register("anonymize_documents", _redact_sql("anonymize"))
def anonymize_documents(spark, sf_dir):
    """F1+F2+F3 in anonymize mode: spans replaced by type labels."""
    return _redact(spark, sf_dir, "anonymize")


@register("redact_mixed_modes", f"""{_DETM}, RS AS (
      SELECT doc_id, char_start, char_end,
             {sk.replacement_sql('text', 'type', 'action_mode', 'custom_replacement', 'global_mode')} AS rep
      FROM DM WHERE status IN ('redacted', 'added'))
    {sk.rewrite_sql('RS')}""")
def redact_mixed_modes(spark, sf_dir):
    """F3 with per-span modes and custom replacements (F12: from stored text)."""
    def rep(x):
        action, custom, whole = cm.review_modes(F.col("doc_id"), x["char_start"])
        return rd.replacement_text(x["text"], x["type"], action, custom, whole)
    return rd.redact_detected(dt.detect_arrays(cm.documents_with_policy(spark, sf_dir)), rep)


@register("mask_by_rule", f"""{_DET}
    SELECT doc_id, det_id, rule,
           CASE WHEN rule = 'mask_partial' AND length(text) > 4 THEN repeat({sk.q(tb.BLOCK_CHAR)}, length(text) - 4) || right(text, 4)
                ELSE {sk.block_sql('text')} END AS masked
    FROM DET WHERE rule IS NOT NULL""")
def mask_by_rule(spark, sf_dir):
    """F8 (opt-in policy_rule mode): mask_partial shows the last 4 characters."""
    d = cm.detections(spark, sf_dir).filter(F.col("rule").isNotNull())
    return d.select("doc_id", "det_id", "rule", rd.mask_by_rule(F.col("text"), F.col("rule")).alias("masked"))


@register("redact_by_value", f"""WITH RECURSIVE {sk.pipeline_sql()},
    V AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, det_id) AS i, text AS v,
                 {sk.block_sql('text')} AS rep
          FROM DET WHERE status IN ('redacted', 'added')),
    RV(doc_id, i, t) AS (
      SELECT doc_id, 0, text FROM documents WHERE doc_id IN (SELECT doc_id FROM V)
      UNION ALL
      SELECT rv.doc_id, rv.i + 1, CASE WHEN length(v.v) > 0 THEN replace(rv.t, v.v, v.rep) ELSE rv.t END
      FROM RV rv JOIN V v ON v.doc_id = rv.doc_id AND v.i = rv.i + 1)
    SELECT d.doc_id, coalesce(r.t, d.text) AS text
    FROM documents d LEFT JOIN (SELECT doc_id, arg_max(t, i) AS t FROM RV GROUP BY doc_id) r ON r.doc_id = d.doc_id""")
def redact_by_value(spark, sf_dir):
    """every occurrence of each confirmed text is replaced (value
    propagation, as for PDF/DOCX), in detection order."""
    docs = cm.documents(spark, sf_dir)
    d = rd.confirmed(cm.detections(spark, sf_dir))
    d = d.select("doc_id", "text", rd.block(F.col("text")).alias("rep"),
                 F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "det_id"))
                 .cast("bigint").alias("ord"))
    return rd.redact_by_value(docs, d).select("doc_id", "text")


@register("highlight_annotations", f"""{_DETM}
    SELECT doc_id, det_id, char_start, char_end, colour, reason FROM (
      SELECT *, CASE WHEN {sk.mode_sql('action_mode', 'global_mode')} = 'highlight_red' THEN 'red'
                     WHEN {sk.mode_sql('action_mode', 'global_mode')} = 'highlight' THEN
                          CASE WHEN (CASE WHEN action_mode IN ('redact', 'anonymize') THEN action_mode ELSE global_mode END) = 'anonymize'
                               THEN 'green' ELSE 'yellow' END END AS colour
      FROM DM WHERE status IN ('redacted', 'added')) WHERE colour IS NOT NULL""")
def highlight_annotations(spark, sf_dir):
    """highlight modes keep the text and emit (span, colour, reason)."""
    d = rd.confirmed(cm.with_review_modes(cm.detections(spark, sf_dir)))
    return rd.highlight_annotations(d, F.col("global_mode"))


_CELLS_SQL = """SELECT doc_id || ':' || (i - 1) AS doc_id, doc_id AS src_doc, i - 1 AS cell_idx, cells[i] AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS cells, generate_series(1, len(string_split(text, chr(10)))) AS ii
          FROM documents), unnest(ii) AS t(i)"""


@register("redact_table_cells", f"""WITH CE AS ({_CELLS_SQL}),
    HS AS (SELECT h.doc_id, h.char_start, h.char_end, h.type, h.confidence, h.status, h.reason, h.source,
                  NULL AS policy, NULL AS rule, h.h_rank, c.text AS doc
           FROM ({sk.heuristic_sql('SELECT doc_id, text FROM CE')}) h JOIN CE c ON c.doc_id = h.doc_id),
    {sk.islands_sql('HS', 'h_rank')},
    RS AS (SELECT doc_id, char_start, char_end, {sk.block_sql('text')} AS rep FROM FI),
    OUT AS (SELECT c.doc_id, c.src_doc, c.cell_idx,
                   CASE WHEN g.doc_id IS NULL THEN c.text ELSE g.body || substr(c.text, CAST(g.last_e AS INTEGER) + 1) END AS text
            FROM CE c LEFT JOIN (
              SELECT r.doc_id, string_agg(substr(c2.text, CAST(r.prev AS INTEGER) + 1, CAST(r.char_start - r.prev AS INTEGER)) || r.rep, '' ORDER BY r.char_start) AS body,
                     max(r.char_end) AS last_e
              FROM (SELECT *, coalesce(lag(char_end) OVER (PARTITION BY doc_id ORDER BY char_start), 0) AS prev FROM RS) r
              JOIN CE c2 ON c2.doc_id = r.doc_id GROUP BY r.doc_id) g ON g.doc_id = c.doc_id)
    SELECT src_doc AS doc_id, CAST(cell_idx AS INTEGER) AS cell_idx, text FROM OUT""")
def redact_table_cells(spark, sf_dir):
    """F7 re-aimed: detect and redact per cell (line), so offsets always
    refer to the cell they were found in.  Every cell of the file comes back."""
    docs = read_table(spark, sf_dir, "documents")
    cells = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("cell_idx", "text"))
    return rd.redact_cells(cells, "text")


def _meta_cols(pages):
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    kind = F.when(F.pmod("page_id", F.lit(2)) == 0, "pdf").otherwise("docx")
    meta = F.create_map(F.lit("author"), F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("")).otherwise(host),
                        F.lit("creator"), host, F.lit("producer"), F.lit(""), F.lit("title"), title,
                        F.lit("last_modified_by"), F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit("editor")).otherwise(F.lit("")),
                        F.lit("comments"), F.lit(""),
                        F.lit("revision"), F.pmod("page_id", F.lit(4)).cast("string"))
    return pages.select("page_id", kind.alias("kind"), meta.alias("meta"))


def _audit_item_sql(field: str, template: str, engine: str = "Spanveil") -> str:
    t = template.replace("{engine}", engine)
    if "{v}" in t:
        a, b = t.split("{v}")
        txt = f"{sk.q(a)} || meta['{field}'] || {sk.q(b)}"
    else:
        txt = sk.q(t)
    return f"CASE WHEN length(coalesce(meta['{field}'], '')) > 0 THEN {txt} END"


def _meta_sql() -> str:
    return """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'docx' END AS kind,
        MAP {'author': CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(url, '^[a-z]+://([^/]+)', 1) END,
             'creator': regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'producer': '',
             'title': regexp_extract(html, '<title>([^<]*)</title>', 1),
             'last_modified_by': CASE WHEN page_id % 5 = 0 THEN 'editor' ELSE '' END, 'comments': '',
             'revision': CAST(page_id % 4 AS VARCHAR)} AS meta FROM pages"""


_PDF_ITEMS = ", ".join(_audit_item_sql(f, t) for f, t in tb.PDF_METADATA_AUDIT)
_DOCX_ITEMS = ", ".join(_audit_item_sql(f, t) for f, t in tb.DOCX_METADATA_AUDIT)
_REV = tb.DOCX_REVISION_AUDIT.split("{v}")


@register("strip_metadata", f"""SELECT page_id, kind,
      CASE WHEN kind = 'pdf' THEN list_filter([{_PDF_ITEMS}], lambda x: x IS NOT NULL)
           ELSE list_filter([{_DOCX_ITEMS},
                CASE WHEN CAST(meta['revision'] AS INTEGER) > 1 THEN {sk.q(_REV[0])} || meta['revision'] || {sk.q(_REV[1])} END],
                lambda x: x IS NOT NULL) END AS audit
    FROM ({_meta_sql()})""")
def strip_metadata(spark, sf_dir):
    """audit strings for every identifying metadata field (metadata
    derived from the pages table: title, host, revision)."""
    m = _meta_cols(read_table(spark, sf_dir, "pages"))
    return m.select("page_id", "kind", rd.metadata_audit(F.col("meta"), F.col("kind")).alias("audit"))


@register("extract_metadata", """SELECT page_id, '' AS author, '' AS creator, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
      '' AS created, '' AS modified, '' AS tool FROM pages WHERE html IS NOT NULL AND NOT regexp_matches(html, '(?i)<meta[^>]*(name|property|http-equiv)')
    UNION ALL SELECT page_id, '', '', '', '', '', '' FROM pages WHERE html IS NULL""")
def extract_metadata(spark, sf_dir):
    """author, creator, title, dates and tool of every page, '' where it gives none.  The SQL knows that the given pages name
    nothing but a title; tests hold the other fields."""
    return read_table(spark, sf_dir, "pages").select("page_id", rd.extract_metadata(F.col("html")).alias("m")).select("page_id", "m.*")


_LISTED = ", ".join(sk.q(f) for f, _ in tb.DOCX_METADATA_AUDIT)


@register("clean_metadata", f"""
    WITH M AS ({_meta_sql()}),
    K AS (SELECT page_id, kind, unnest(map_keys(meta)) AS k, unnest(map_values(meta)) AS v FROM M WHERE kind = 'docx'),
    P AS (SELECT page_id, kind, unnest(['author', 'creator', 'producer', 'title', 'subject', 'keywords', 'creationDate', 'modDate']) AS field,
                 unnest(['', 'Spanveil Redaction Engine', 'Spanveil', 'Redacted Document', '', '', '', '']) AS value FROM M WHERE kind = 'pdf')
    SELECT page_id, kind, k AS field, CASE WHEN k NOT IN ({_LISTED}, 'revision') OR coalesce(length(v), 0) = 0 THEN v
           WHEN k = 'title' THEN 'Redacted Document' WHEN k = 'revision' THEN '1' ELSE '' END AS value FROM K
    UNION ALL SELECT * FROM P""")
def clean_metadata(spark, sf_dir):
    """the metadata that an exported file carries, one row per field."""
    m = _meta_cols(read_table(spark, sf_dir, "pages"))
    return m.select("page_id", "kind", F.explode(rd.clean_metadata(F.col("meta"), F.col("kind"))).alias("field", "value"))


@register("redact_nodes", f"""WITH RECURSIVE {sk.pipeline_sql()},
    V AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, det_id) AS i, text AS v,
                 {sk.block_sql('text')} AS rep
          FROM DET WHERE status IN ('redacted', 'added') AND NOT contains(text, chr(10))),
    N AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS node_ord, unnest(string_split(text, chr(10))) AS text FROM documents),
    RV(doc_id, node_ord, i, t) AS (
      SELECT doc_id, node_ord, 0, text FROM N WHERE doc_id IN (SELECT doc_id FROM V)
      UNION ALL
      SELECT rv.doc_id, rv.node_ord, rv.i + 1, CASE WHEN length(v.v) > 0 THEN replace(rv.t, v.v, v.rep) ELSE rv.t END
      FROM RV rv JOIN V v ON v.doc_id = rv.doc_id AND v.i = rv.i + 1)
    SELECT n.doc_id, CAST(n.node_ord AS INTEGER) AS node_ord, coalesce(r.t, n.text) AS text
    FROM N n LEFT JOIN (SELECT doc_id, node_ord, arg_max(t, i) AS t FROM RV GROUP BY ALL) r ON r.doc_id = n.doc_id AND r.node_ord = n.node_ord""")
def redact_nodes(spark, sf_dir):
    """F4/F5 node scope: each confirmed text replaced in every node (here: line) of its document, as in
    paragraphs, table cells, headers and footers."""
    docs = cm.documents(spark, sf_dir)
    nodes = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("node_ord", "text"))
    d = rd.confirmed(cm.detections(spark, sf_dir)).filter(~F.contains("text", F.lit("\n")))
    d = d.select("doc_id", "text", rd.block(F.col("text")).alias("rep"),
                 F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "det_id")).cast("bigint").alias("ord"))
    return rd.redact_by_value(nodes, d).select("doc_id", F.col("node_ord").cast("int").alias("node_ord"), "text")


#: read without a pattern for the whole attribute: cut at the word, look at the ends of the pieces on both sides
_LINKS_SQL = f"""
    C AS (SELECT page_id, string_split_regex(html, '[hH][rR][eE][fF]') AS parts FROM pages),
    L AS (SELECT page_id, i, right(parts[i], 1) AS before, ltrim(parts[i + 1], chr(32) || chr(9) || chr(10) || chr(13)) AS rest
          FROM C, unnest(generate_series(1, len(parts) - 1)) AS t(i)),
    V AS (SELECT page_id, i, ltrim(substr(rest, 2), chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM L
          WHERE left(rest, 1) = '=' AND NOT regexp_matches(before, '[A-Za-z0-9_-]')),
    U AS (SELECT page_id, i, CASE WHEN left(v, 1) IN ('"', chr(39)) THEN split_part(substr(v, 2), left(v, 1), 1)
                                  ELSE regexp_extract(v, '^[^ \\t\\n\\r"''>]+', 0) END AS uri FROM V)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS link_idx, uri,
           {sk.q(tb.LINK_AUDIT.split('{v}')[0])} || uri || {sk.q(tb.LINK_AUDIT.split('{v}')[1])} AS audit, CAST(0 AS BIGINT) AS n_after FROM U"""


@register("detach_links", f"WITH {_LINKS_SQL}")
def detach_links(spark, sf_dir):
    """F11 re-aimed to HTML pages: one audit row per detached URI; the
    cleaned page keeps no href (n_after = 0)."""
    pages = read_table(spark, sf_dir, "pages")
    uris, cleaned = rd.detach_links(F.col("html"))
    p = pages.select("page_id", uris.alias("uris"),
                     F.size(F.regexp_extract_all(cleaned, F.lit(r"(?i)(?<![\w-])href\s*="), F.lit(0))).alias("n_after"))
    parts = tb.LINK_AUDIT.split("{v}")
    return p.select("page_id", F.posexplode("uris").alias("link_idx", "uri"), "n_after").select(
        "page_id", F.col("link_idx").cast("int").alias("link_idx"), "uri",
        F.concat(F.lit(parts[0]), F.col("uri"), F.lit(parts[1])).alias("audit"), F.col("n_after").cast("bigint").alias("n_after"))


@register("live_preview", f"""{_DET}, RS AS (SELECT doc_id, char_start, char_end, {sk.replacement_sql('text', 'type', 'NULL', 'NULL', "'redact'")} AS rep
                                      FROM DET WHERE status IN ('redacted', 'added')),
    PV AS ({sk.rewrite_sql('RS')}),
    Q AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]{{6,}}', 0) AS query FROM documents
          WHERE length(regexp_extract(text, '[A-Za-z]{{6,}}', 0)) > 0),
    S AS (SELECT q.doc_id, q.query, p.text FROM Q q JOIN PV p ON p.doc_id = q.doc_id)
    SELECT doc_id, 'preview' AS kind, CAST(0 AS BIGINT) AS char_start, CAST(length(text) AS BIGINT) AS char_end, text FROM PV
    UNION ALL
    SELECT s.doc_id, 'highlight', CAST(x.s AS BIGINT), CAST(x.e AS BIGINT), x.m
    FROM ({sk.spans_sql('SELECT doc_id, text, query FROM S', '__P__')}) x JOIN S s ON s.doc_id = x.doc_id""".replace(
    "'__P__'", "'(?i)\\Q' || query || '\\E'"))
def live_preview(spark, sf_dir):
    """redacted preview of every document plus the highlight entries of
    the reviewer's search string found in the preview."""
    from ..operators import structure as st
    prev = _redact(spark, sf_dir, "redact")
    docs = cm.documents(spark, sf_dir)
    qs = docs.select("doc_id", F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("query")).filter(F.length("query") > 0)
    hl = st.search_highlight(prev, qs).select("doc_id", F.lit("highlight").alias("kind"), "char_start", "char_end",
                                              F.col("match").alias("text"))
    pv = prev.select("doc_id", F.lit("preview").alias("kind"), F.lit(0).cast("bigint").alias("char_start"),
                     F.length("text").cast("bigint").alias("char_end"), "text")
    return pv.unionByName(hl)
