"""Detection operators: pattern spans, policy filter, source merge, word
alignment and overlap union.

Plan shape: everything about one document happens in one narrow stage over
its text (Arrow batches, ``functions.docspans``): matching, policy, merge of
the sources, word alignment and union.  ``detect_pipeline`` has no exchange
unless policies or model entities come as tables of their own, which are then
joined on ``doc_id``.  The single steps are also operators over span tables;
those gather the spans (never the text) of a document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import docspans as ds
from ..functions import spans as sp
from ..functions import tables as tb
from ..functions.batches import small
from ..session import sql_over

DETECTION_COLUMNS = [
    "doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status",
    "reason", "source", "policy", "rule",
]


def _pattern_rows(patterns: Sequence) -> list[tuple]:
    rows = []
    for p in patterns:
        if isinstance(p, dict):
            p = (p["name"], p["regex"], p["type"], p["confidence"], p.get("reason", ""))
        rows.append(tuple(p))
    return rows


def matcher(patterns: Sequence) -> Callable[[], ds.Matcher]:
    """A maker of the compiled patterns (compiled once per task).  A pattern that matches the empty
    string, or none at all, is refused (I2)."""
    rows = [(r[1], sp.required_literals(r[1])) for r in _pattern_rows(patterns)]
    for (compiled, *_), row in zip(ds.Matcher(rows).patterns, rows, strict=True):
        if compiled.match(""):
            raise ValueError(f"pattern matches the empty string: {row[0]}")
    return lambda: ds.Matcher(rows)


#: patterns of a pattern table, at most: it is configuration, held by every task
MOST_PATTERNS = 20_000


def pattern_rows(patterns: DataFrame) -> list[tuple]:
    """A pattern table (pattern_id, name, regex, type, confidence, reason) as rows in the order of pattern_id.  Null or empty patterns, ones that do not
    compile or match the empty string, and more than ``MOST_PATTERNS`` are refused with the ids they have."""
    rows = patterns.select("pattern_id", "name", "regex", "type", F.col("confidence").cast("double"), F.coalesce("reason", F.lit(""))).orderBy(
        "pattern_id", "name", "regex").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    bad = []
    for r in rows:
        try:
            if not r["regex"] or re.compile(r["regex"]).match(""):
                bad.append(r["pattern_id"])
        except re.error:
            bad.append(r["pattern_id"])
    if bad:
        raise ValueError(f"patterns that cannot be used: {bad}")
    return [tuple(r)[1:] for r in rows]


def table_spans(docs: DataFrame, patterns: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """All matches of the patterns of a table (I2, C1), as ``pattern_spans``; pat_idx counts the table's rows from 0 in the order of pattern_id.  All patterns are
    looked for in one pass over a text (``docspans.AutomatonMatcher``)."""
    rows = pattern_rows(patterns)
    regexes = [r[1] for r in rows]
    return pattern_spans(docs, rows, text_col, id_col, keep=keep, make=lambda: ds.AutomatonMatcher(regexes))


def _rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SPAN_FIELDS = [("pat_idx", pa.int32()), ("match_idx", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()),
                ("text", pa.string()), ("type", pa.string()), ("base_conf", pa.float64()), ("base_reason", pa.string())]
_SPAN_SQL = ("pat_idx int, match_idx int, char_start bigint, char_end bigint, text string, type string, "
             "base_conf double, base_reason string")


def pattern_spans(docs: DataFrame, patterns: Sequence = tb.HEURISTIC_PATTERNS, text_col: str = "text",
                  id_col: str = "doc_id", with_context: bool = False, keep: Sequence[str] = (),
                  make: Callable[[], object] | None = None) -> DataFrame:
    """All matches of every pattern (C1, C2): one row per span.

    Output: doc_id, *keep, pat_idx, match_idx, char_start, char_end, text, type, base_conf, base_reason.
    Spans are produced per pattern with leftmost non-overlapping semantics;
    matches whose trimmed text is shorter than 3 characters are dropped.
    ``with_context`` adds ``ctx_o``/``ctx``: the tokens that the span touches
    and where they start, cut while the document is at hand (map side), so
    later shuffles move spans and not documents.
    """
    rows = _pattern_rows(patterns)
    make = make or matcher(patterns)
    src = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    n = 1 + len(keep)
    fields = _SPAN_FIELDS + ([("ctx_o", pa.int32()), ("ctx", pa.string())] if with_context else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()
        for batch in small(batches):
            at, out = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                tokens = None
                for p, j, s, e, m in found.find(text) if text else ():
                    at.append(i)
                    row = (p, j, s, e, m, *rows[p][2:5])
                    if with_context:
                        tokens = tokens or ds.Tokens(text)
                        cover = tokens.cover(s, e) or [(s, e)]
                        lo = min(s, cover[0][0])
                        row += (lo, text[lo:max(e, cover[-1][1])])
                    out.append(row)
            spans = _rows_batch([(*r[:6], float(r[6]), *r[7:]) for r in out], pa.schema(fields))
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*kept, *spans.columns], names=[*batch.schema.names[:n], *spans.schema.names])
    schema = StructType(src.schema.fields[:-1])
    for f in StructType.fromDDL(_SPAN_SQL + (", ctx_o int, ctx string" if with_context else "")):
        schema = schema.add(f)
    return src.mapInArrow(run, schema)


def heuristic_detections(docs: DataFrame, patterns: Sequence = tb.HEURISTIC_PATTERNS,
                         text_col: str = "text", with_context: bool = False) -> DataFrame:
    """Pattern detector with status bands and reasons.

    Keeps ``h_rank`` (pattern order, then match order): the list order that
    the source merge depends on.
    """
    return heuristic_from_spans(pattern_spans(docs, patterns, text_col, with_context=with_context))


def heuristic_from_spans(s: DataFrame) -> DataFrame:
    return s.selectExpr(
        "doc_id", f"CAST(pat_idx AS BIGINT) * {1 << 32} + match_idx AS h_rank",
        "text", "char_start", "char_end", "type", "base_conf AS confidence",
        f"CASE WHEN base_conf >= {tb.REDACT_AT} THEN 'redacted' WHEN base_conf >= {tb.REVIEW_AT} THEN 'missed' "
        "ELSE 'false_positive' END AS status",
        f"concat({sp.sql_lit(tb.HEURISTIC_REASON_PREFIX)}, base_reason) AS reason", "'heuristic' AS source",
        *[c for c in ("ctx_o", "ctx") if c in s.columns],
    )


def with_det_id(df: DataFrame) -> DataFrame:
    return df.withColumn("det_id", F.expr(sp.DET_ID_SQL))


# ---------------------------------------------------------------------------
# Model side: stand-in raw entities + policy filter (I1 hook, C4, C6-C9)
# ---------------------------------------------------------------------------

def standin_raw_entities(docs: DataFrame, text_col: str = "text", with_context: bool = False) -> DataFrame:
    """Reproducible stand-in for model output (no weights are available).

    raw_entities(doc_id, label, text, char_start, char_end, score): pattern
    candidates scored by ``round(0.40 + ((doc_id*37 + char_start) % 60)/100, 2)``.
    """
    return standin_from_spans(pattern_spans(docs, STANDIN_PATTERNS, text_col, with_context=with_context))


STANDIN_PATTERNS = [(label, regex, label, 0.0, "") for label, regex in tb.STANDIN_ENTITY_PATTERNS]


STANDIN_SCORE_SQL = "CAST(round(0.40 + pmod(doc_id * 37 + char_start, 60) / 100.0, 2) AS DOUBLE)"


def standin_from_spans(s: DataFrame) -> DataFrame:
    return s.selectExpr("doc_id", "type AS label", "text", "char_start", "char_end", f"{STANDIN_SCORE_SQL} AS score",
                        *[c for c in ("ctx_o", "ctx") if c in s.columns])


def stitch_sql(arr: str) -> str:
    """SQL text of ``spans.stitch``: join overlapping (offset, text) pieces."""
    srt = f"array_sort({arr})"
    step = ("CASE WHEN _p.o + length(_p.t) > _sa.o + length(_sa.t) THEN named_struct('o', _sa.o, 't', "
            "concat(_sa.t, substring(_p.t, _sa.o + length(_sa.t) - _p.o + 1, _p.o + length(_p.t) - _sa.o - length(_sa.t)))) "
            "ELSE _sa END")
    return (f"aggregate(slice({srt}, 2, greatest(size({arr}) - 1, 0)), "
            f"named_struct('o', element_at({srt}, 1).o, 't', element_at({srt}, 1).t), (_sa, _p) -> {step})")


def _pct_sql(conf: str) -> str:
    return f"concat(CAST(CAST(bround({conf} * 100, 0) AS BIGINT) AS STRING), '%')"


def _fill_sql(template: str, **vals: str) -> str:
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in vals if rest.find("{" + k + "}") >= 0]
        if not hits:
            parts.append(sp.sql_lit(rest))
            break
        pos, key = min(hits)
        if pos:
            parts.append(sp.sql_lit(rest[:pos]))
        parts.append(vals[key])
        rest = rest[pos + len(key) + 2:]
    return "concat(" + ", ".join(parts) + ")"


def model_reason_sql(label: str, conf: str, policy: str) -> str:
    """Reason text for model detections (C9); rule 1 is substring based."""
    up = f"upper({label})"
    shown = f"replace({up}, '_', ' ')"
    pct = _pct_sql(conf)
    return (f"CASE WHEN contains({up}, 'PERSON') OR contains({up}, 'NAME') THEN "
            f"{_fill_sql(tb.MODEL_REASON_PERSON, label=shown, pct=pct, policy=policy)} "
            f"WHEN contains({up}, 'IBAN') OR contains({up}, 'ACCOUNT') OR contains({up}, 'CARD') THEN "
            f"{_fill_sql(tb.MODEL_REASON_FINANCIAL, label=shown, pct=pct)} "
            f"WHEN contains({up}, 'PASSWORD') OR contains({up}, 'KEY') OR contains({up}, 'TOKEN') THEN "
            f"{_fill_sql(tb.MODEL_REASON_SECRET, label=shown)} "
            f"ELSE {_fill_sql(tb.MODEL_REASON_DEFAULT, label=shown, pct=pct, policy=policy)} END")


def _policy_map(value: Callable[[tuple], str]) -> str:
    return "map(" + ", ".join(f"{sp.sql_lit(name)}, {value(p)}" for name, p in tb.POLICIES.items()) + ")"


def resolve_policies(doc_policies: DataFrame) -> DataFrame:
    """Per document: its policy as given (null means mixed_general), and the labels
    (a non-empty custom list replaces them, C7; bad JSON means none),
    threshold and rule of that policy, or of mixed_general if it is unknown.
    ``doc_policies``: doc_id, policy[, custom_labels].  The policies are literals in the
    plan: no join."""
    known = _policy_map(lambda p: "true")
    policy = f"coalesce(policy, {sp.sql_lit(tb.DEFAULT_POLICY)})"
    used = f"CASE WHEN try_element_at({known}, {policy}) THEN {policy} ELSE {sp.sql_lit(tb.DEFAULT_POLICY)} END"
    labels = _policy_map(lambda p: "array(" + ", ".join(sp.sql_lit(x) for x in p[0]) + ")")
    labels = f"try_element_at({labels}, {used})"
    if "custom_labels" in doc_policies.columns:
        custom = "from_json(custom_labels, 'array<string>')"
        labels = f"CASE WHEN size(coalesce({custom}, array())) > 0 THEN {custom} ELSE {labels} END"
    return doc_policies.selectExpr(
        "doc_id", f"{policy} AS policy", f"{labels} AS labels",
        f"try_element_at({_policy_map(lambda p: f'double({p[1]})')}, {used}) AS threshold",
        f"try_element_at({_policy_map(lambda p: sp.sql_lit(p[2]))}, {used}) AS rule")


def policy_filter(raw_entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Model detections allowed by each document's policy.

    Equi join on doc_id with the per-document policy rows (shuffle by
    doc_id, or a broadcast when AQE measures that side small)."""
    ctx = ", r.ctx_o, r.ctx" if "ctx" in raw_entities.columns else ""
    conf = "round(r.score, 2)"
    reason = model_reason_sql("r.label", conf, "p.policy").replace("{", "{{").replace("}", "}}")
    return sql_over(raw_entities.sparkSession, f"""
        SELECT r.doc_id, r.text, r.char_start, r.char_end, upper(r.label) AS type, {conf} AS confidence,
               CASE WHEN {conf} >= {tb.REDACT_AT} THEN 'redacted' ELSE 'missed' END AS status,
               {reason} AS reason,
               {sp.sql_lit(tb.MODEL_SOURCE)} AS source, p.policy, p.rule{ctx}
        FROM {{raw}} r JOIN {{res}} p ON r.doc_id = p.doc_id
        WHERE array_contains(p.labels, r.label) AND r.score >= p.threshold""", raw=raw_entities, res=resolved)


def label_groups(spark, raw_entities: DataFrame) -> DataFrame:
    """Taxonomy roll-up (C8): raw entities per label group (42-row broadcast table)."""
    tax = F.broadcast(tb.taxonomy_df(spark))
    return (raw_entities.join(tax, "label", "left")
            .groupBy(F.coalesce(F.col("label_group"), F.lit("unknown")).alias("label_group"))
            .agg(F.count(F.lit(1)).alias("n_entities"), F.countDistinct("doc_id").alias("n_docs")))


# ---------------------------------------------------------------------------
# Context for spans that arrive without it (external model output)
# ---------------------------------------------------------------------------

def attach_context(spans: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``ctx_o``/``ctx`` to spans produced elsewhere (e.g. a model hook).

    This joins on doc_id and therefore moves documents, each once with all its spans; spans
    produced by this package get their context map side instead.
    """
    rows = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*spans.columns)).alias("_spans"))
    joined = rows.join(docs.select("doc_id", F.col(text_col).alias("_doc")), "doc_id").select("_spans", "_doc")
    names = spans.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ctx = []
            for found, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = ds.Tokens(text or "")
                for s in found:
                    lo, hi = s["char_start"], min(s["char_end"], len(text or ""))
                    cover = tokens.cover(lo, hi) or [(lo, hi)]
                    lo = min(lo, cover[0][0])
                    ctx.append((lo, text[lo:max(hi, cover[-1][1])] if text else ""))
            flat = batch.column(0).flatten()
            tail = _rows_batch(ctx, pa.schema([("ctx_o", pa.int32()), ("ctx", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in names), *tail.columns], names=[*names, "ctx_o", "ctx"])
    return joined.mapInArrow(run, StructType([*spans.schema.fields, *StructType.fromDDL("ctx_o int, ctx string").fields]))


# ---------------------------------------------------------------------------
# Merge of model and heuristic spans
# ---------------------------------------------------------------------------

_MERGED = [("doc_id", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("type", pa.string()), ("confidence", pa.float64()),
           ("status", pa.string()), ("reason", pa.string()), ("source", pa.string()), ("policy", pa.string()), ("rule", pa.string()),
           ("grp", pa.int32()), ("ord", pa.int64()), ("ctx_o", pa.int32()), ("ctx", pa.string())]
_MERGED_SQL = ("doc_id bigint, char_start bigint, char_end bigint, type string, confidence double, status string, reason string, "
               "source string, policy string, rule string, grp int, ord bigint, ctx_o int, ctx string")


def _stitched(members: list[tuple[int, str]], start: int, end: int) -> tuple[int, str]:
    """The text pieces that lie around [start, end) as one: members of a merged span overlap, so no gap is left."""
    o, t = None, ""
    for po, pt in sorted(members):
        if o is None:
            o, t = po, pt
        elif po + len(pt) > o + len(t):
            t += pt[o + len(t) - po:]
    return o, t


def merge_sources(model: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Each heuristic span, in order, joins the first overlapping entry of the growing list
    (model spans, then heuristic spans appended before): union of bounds, max confidence, one
    reason suffix per strict raise, source ``dual``, promotion to redacted.
    Without an overlap it is appended.  Output carries ``grp``/``ord``:
    the stable list order (model spans first, then appended heuristics).

    Both inputs carry ``ctx_o``/``ctx``; a merged span's context is the
    stitched union of its members' contexts.  One exchange gathers the spans of a document; the fold works on
    islands of overlapping spans, so it is linear in the spans of a document but for such islands.
    """
    cols = ["char_start", "char_end", "type", "confidence", "status", "reason", "source", "policy", "rule", "grp", "ord", "ctx_o", "ctx", "text"]
    m = model.selectExpr("doc_id", "char_start", "char_end", "type", "confidence", "status", "reason",
                         f"coalesce(source, {sp.sql_lit(tb.MODEL_SOURCE)}) AS source", "policy", "rule", "0 AS grp",
                         "CAST(0 AS BIGINT) AS ord", "CAST(ctx_o AS INT) AS ctx_o", "ctx", "text")
    h = heuristic.selectExpr("doc_id", "char_start", "char_end", "type", "confidence", "status", "reason", "source",
                             "CAST(NULL AS STRING) AS policy", "CAST(NULL AS STRING) AS rule", "1 AS grp", "h_rank AS ord",
                             "CAST(ctx_o AS INT) AS ctx_o", "ctx", "text")
    gathered = m.unionByName(h).groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = sorted((s for s in spans if s["grp"] == 0), key=_model_order)
                for i, s in enumerate(mine):
                    s["ord"] = i + 1
                pieces = sorted((s["char_start"], s["ctx_o"], s["ctx"]) for s in spans)
                at = 0
                merged = ds.merge_sources(mine, sorted((s for s in spans if s["grp"]), key=lambda s: s["ord"]))
                for s in sorted(merged, key=lambda s: (s["char_start"], s["char_end"])):
                    while at < len(pieces) and pieces[at][0] < s["char_start"]:
                        at += 1
                    members = []
                    for k in range(at, len(pieces)):
                        if pieces[k][0] >= s["char_end"]:
                            break
                        members.append(pieces[k][1:])
                    o, t = _stitched(members, s["char_start"], s["char_end"])
                    rows.append((doc, *(s[c] for c in cols[:11]), o, t))
            yield _rows_batch(rows, pa.schema(_MERGED))
    return gathered.mapInArrow(run, _MERGED_SQL)


def _model_order(s: dict) -> tuple:
    return s["char_start"], s["char_end"], s["type"], s["text"]


# ---------------------------------------------------------------------------
# Word alignment (C13) and overlap union (C14)
# ---------------------------------------------------------------------------

def align_words(dets: DataFrame) -> DataFrame:
    """Expand every span to the tokens it touches; drop one trailing
    punctuation token when more than one token matched; re-cut the text.

    Tokens never cross whitespace, so tokenising the whitespace-free runs
    around the span (``ctx``, starting at ``ctx_o``) gives the same tokens as
    tokenising the whole document.  Spans without tokens keep their bounds.
    ``pre_start`` keeps the start before alignment (the stable sort key).
    """
    punct = ", ".join(sp.sql_lit(x) for x in tb.TRAILING_PUNCTUATION)
    toks = (f"filter({sp.regex_spans_sql('ctx', tb.TOKEN_PATTERN_POSSESSIVE)}, "
            f"_t -> _t.s + ctx_o < char_end AND _t.e + ctx_o > char_start)")
    cols = [c for c in dets.columns if c not in ("char_start", "char_end", "text")]
    keep = ", ".join(cols)
    brace = lambda x: x.replace("{", "{{").replace("}", "}}")
    return sql_over(dets.sparkSession, f"""
    WITH T AS (SELECT *, char_start AS pre_start, {brace(toks)} AS _t FROM {{v}}),
    T2 AS (SELECT *, CASE WHEN size(_t) > 1 AND element_at(_t, -1).m IN ({brace(punct)}) THEN slice(_t, 1, size(_t) - 1)
                          ELSE _t END AS _u FROM T),
    T3 AS (SELECT *, CAST(CASE WHEN size(_u) > 0 THEN element_at(_u, 1).s + ctx_o ELSE char_start END AS BIGINT) AS _s,
                     CAST(CASE WHEN size(_u) > 0 THEN element_at(_u, -1).e + ctx_o ELSE char_end END AS BIGINT) AS _e
           FROM T2)
    SELECT {keep}, pre_start, _s AS char_start, _e AS char_end,
           CASE WHEN _e > _s THEN substring(ctx, CAST(_s - ctx_o AS INT) + 1, CAST(_e - _s AS INT)) ELSE '' END AS text
    FROM T3""", v=dets)


def merge_overlaps(dets: DataFrame, order_cols: Iterable[str] = ("grp", "ord")) -> DataFrame:
    """Union of strictly overlapping spans, transitively (gaps and islands).

    Rows are taken in (char_start, *order_cols) order.  Start from the first
    span, end = max end, confidence and type from the strictly highest
    confidence (first wins ties), everything else from the first span.
    Touching spans stay apart.  The text of an island is stitched from its
    members' texts (they overlap, so their union is contiguous).
    """
    order_cols = list(order_cols)
    order = ", ".join(["char_start"] + order_cols)
    skip = {"doc_id", "char_start", "char_end", "confidence", "type", "text", "ctx", "ctx_o", *order_cols}
    other = [c for c in dets.columns if c not in skip]
    firsts = ", ".join(f"min_by({c}, _rn) AS {c}" for c in other + order_cols)
    firsts = (", " + firsts) if firsts else ""
    return sql_over(dets.sparkSession, f"""
    WITH A AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS _rn,
                      max(char_end) OVER (PARTITION BY doc_id ORDER BY {order}
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _pe FROM {{v}}),
    B AS (SELECT *, sum(CASE WHEN _pe IS NULL OR char_start >= _pe THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _isl
          FROM A)
    SELECT doc_id, min(char_start) AS char_start, max(char_end) AS char_end, max(confidence) AS confidence,
           max_by(type, named_struct('c', confidence, 'r', -_rn)) AS type,
           {stitch_sql("collect_list(named_struct('o', CAST(char_start AS INT), 't', text))")}.t AS text{firsts}
    FROM B GROUP BY doc_id, _isl""", v=dets)


def document_detections(doc_id: int, text: str, policy: str | None, custom: str | None, raw: list[dict] | None, found: ds.Matcher,
                        rows: list[tuple]) -> list[dict]:
    """All steps of the pipeline for one document: ``rows`` are the heuristic patterns, then the stand-in's if
    ``raw`` (entities: label, text, char_start, char_end, score) is None."""
    policy = tb.DEFAULT_POLICY if policy is None else policy
    labels, threshold, rule = tb.POLICIES.get(policy, tb.POLICIES[tb.DEFAULT_POLICY])
    try:
        labels = [x for x in json.loads(custom or "[]") if isinstance(x, str)] or labels
    except (ValueError, TypeError):
        pass
    heuristic, entities = [], list(raw or ())
    for p, j, s, e, m in found.find(text):
        _, _, kind, conf, reason = rows[p][:5]
        if raw is None and p >= len(rows) - len(STANDIN_PATTERNS):
            score = round(0.40 + ((doc_id or 0) * 37 + s) % 60 / 100, 2)
            entities.append({"label": kind, "text": m, "char_start": s, "char_end": e, "score": score})
        else:
            heuristic.append({"char_start": s, "char_end": e, "type": kind, "confidence": float(conf), "status": ds.heuristic_status(conf),
                              "reason": tb.HEURISTIC_REASON_PREFIX + reason, "source": "heuristic", "policy": None, "rule": None, "ord": (p << 32) + j})
    model = []
    for x in entities:
        if x["label"] in labels and x["score"] >= threshold:
            conf = round(x["score"], 2)
            model.append({"char_start": x["char_start"], "char_end": x["char_end"], "type": x["label"].upper(), "confidence": conf, "text": x["text"],
                          "status": "redacted" if conf >= tb.REDACT_AT else "missed", "reason": ds.model_reason(x["label"], conf, policy),
                          "source": tb.MODEL_SOURCE, "policy": policy, "rule": rule})
    model.sort(key=_model_order)
    for i, s in enumerate(model):
        s["ord"] = i + 1
    merged = ds.merge_sources(model, heuristic)
    if not merged:
        return []
    tokens = ds.Tokens(text)
    for s in merged:
        s["pre"] = s["char_start"]
        s["char_start"], s["char_end"] = tokens.align(s["char_start"], min(s["char_end"], len(text)))
    merged.sort(key=lambda s: (s["char_start"], s["pre"], s["grp"], s["ord"]))
    return ds.union(merged, text)


_DETECTED = ["text", "char_start", "char_end", "type", "confidence", "status", "reason", "source", "policy", "rule"]


def detect_arrays(docs: DataFrame, doc_policies: DataFrame | None = None, raw_entities: DataFrame | None = None,
                  patterns: Sequence = tb.HEURISTIC_PATTERNS, text_col: str = "text") -> DataFrame:
    """doc_id, text, dets: each document with the array of its detections (C17), in text order.

    One narrow stage over the documents: no exchange and no table in between.  A document's policy (and
    custom_labels) are columns of ``docs``, or come as ``doc_policies`` (doc_id, policy[, custom_labels]), joined on doc_id.
    ``raw_entities`` (doc_id, label, text, char_start, char_end, score) from a model are gathered per
    document and joined; without them the stand-in patterns give reproducible ones.
    """
    given = raw_entities is not None
    rows = list(_pattern_rows(patterns)) + ([] if given else STANDIN_PATTERNS)
    make = matcher(rows)
    if doc_policies is not None:
        docs = docs.drop("policy", "custom_labels").join(doc_policies, "doc_id", "left")
    pick = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    src = docs.select("doc_id", F.col(text_col).alias("_text"), pick("policy").alias("_policy"), pick("custom_labels").alias("_custom"))
    if given:
        fields = ["label", "text", "char_start", "char_end", "score"]
        src = src.join(raw_entities.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("_raw")), "doc_id", "left")
    types = dict([*_SPAN_FIELDS, *_MERGED])
    struct = pa.struct([(c, types[c]) for c in _DETECTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()
        for batch in small(batches):
            out = []
            raws = batch.column(4).to_pylist() if given else [None] * batch.num_rows
            for doc, text, policy, custom, raw in zip(*(c.to_pylist() for c in batch.columns[:4]), raws, strict=True):
                dets = document_detections(doc, text, policy, custom, (raw or []) if given else None, found, rows) if text else []
                out.append([{c: d[c] for c in _DETECTED} for d in dets])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(struct))], names=["doc_id", "text", "dets"])
    schema = StructType.fromDDL("text string, dets array<struct<text:string,char_start:bigint,char_end:bigint,type:string,confidence:double,"
                                "status:string,reason:string,source:string,policy:string,rule:string>>")
    return src.mapInArrow(run, StructType([src.schema["doc_id"], *schema.fields]))


def detect_pipeline(docs: DataFrame, doc_policies: DataFrame | None = None, raw_entities: DataFrame | None = None,
                    patterns: Sequence = tb.HEURISTIC_PATTERNS, text_col: str = "text") -> DataFrame:
    """Model spans, pattern spans, merge, align, union (C17) -> one row per detection."""
    found = detect_arrays(docs, doc_policies, raw_entities, patterns, text_col)
    return with_det_id(found.select("doc_id", F.inline("dets"))).select(*DETECTION_COLUMNS)
