"""Registered detection queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import tables as tb
from ..operators import detect as dt
from ..operators import pieces as pc
from ..session import read_table
from . import common as cm
from . import sqlkit as sk
from .registry import register

_DOCS = "SELECT doc_id, text FROM documents"
_HEUR_COLS = ["doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status", "reason", "source"]


def _heur(spark, sf_dir, patterns):
    h = dt.heuristic_detections(cm.documents(spark, sf_dir), patterns)
    return dt.with_det_id(h).select(*_HEUR_COLS)


def _heur_sql(patterns) -> str:
    return f"""
    SELECT doc_id, {sk.det_id_sql()} AS det_id, text, char_start, char_end, type, confidence, status, reason, source
    FROM (SELECT doc_id, m AS text, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end, type,
                 conf AS confidence,
                 CASE WHEN conf >= 0.85 THEN 'redacted' WHEN conf >= 0.5 THEN 'missed' ELSE 'false_positive' END AS status,
                 {sk.q(tb.HEURISTIC_REASON_PREFIX)} || reason AS reason, 'heuristic' AS source
          FROM ({sk.pattern_spans_sql(_DOCS, patterns)}))
    """


@register("detect_email", _heur_sql([tb.HEURISTIC_PATTERNS[1]]))
def detect_email(spark, sf_dir):
    return _heur(spark, sf_dir, [tb.HEURISTIC_PATTERNS[1]])


@register("detect_ipv4", _heur_sql([tb.HEURISTIC_PATTERNS[2]]))
def detect_ipv4(spark, sf_dir):
    return _heur(spark, sf_dir, [tb.HEURISTIC_PATTERNS[2]])


@register("detect_patterns", _heur_sql(tb.HEURISTIC_PATTERNS))
def detect_patterns(spark, sf_dir):
    return _heur(spark, sf_dir, tb.HEURISTIC_PATTERNS)


#: characters of a piece in the registered query: long documents of the tables come in several
SPLIT_CHARS = 1 << 14


@register("detect_split", _heur_sql(tb.HEURISTIC_PATTERNS))
def detect_split(spark, sf_dir):
    """C1 with long documents in pieces over many tasks, reconciled at the cuts: equals the single pass."""
    h = dt.heuristic_from_spans(pc.split_spans(read_table(spark, sf_dir, "documents"), piece_chars=SPLIT_CHARS))
    return dt.with_det_id(h).select(*_HEUR_COLS)


_EXT_RE2 = [p for p in tb.EXTENDED_PATTERNS]


@register("detect_extended", _heur_sql(_EXT_RE2).replace("'[Heuristic] ' || reason", "reason"))
def detect_extended(spark, sf_dir):
    """Extended pack (C5) with the same detector; DATE 0.60 lands in the missed band."""
    h = dt.heuristic_detections(cm.documents(spark, sf_dir), tb.EXTENDED_PATTERNS)
    h = h.withColumn("reason", F.expr(f"substring(reason, {len(tb.HEURISTIC_REASON_PREFIX) + 1})"))
    return dt.with_det_id(h).select(*_HEUR_COLS)


@register("status_bands", f"""
    SELECT CASE WHEN score >= 0.85 THEN 'redacted' WHEN score >= 0.5 THEN 'missed' ELSE 'false_positive' END AS heuristic_band,
           CASE WHEN score >= 0.85 THEN 'redacted' ELSE 'missed' END AS model_band,
           count(*) AS n
    FROM ({sk.standin_sql()}) GROUP BY 1, 2
""")
def status_bands(spark, sf_dir):
    """Heuristic (C3) and model (C4) status bands over stand-in scores."""
    raw = dt.standin_raw_entities(cm.documents(spark, sf_dir))
    return raw.groupBy(sp.heuristic_status(F.col("score")).alias("heuristic_band"),
                       sp.model_status(F.col("score")).alias("model_band")).agg(F.count(F.lit(1)).alias("n"))


@register("raw_entities", sk.standin_sql())
def raw_entities(spark, sf_dir):
    """I1 stand-in: reproducible raw entity candidates."""
    return dt.standin_raw_entities(cm.documents(spark, sf_dir))


@register("policy_filter", f"""
    SELECT doc_id, {sk.det_id_sql()} AS det_id, text, char_start, char_end, type, confidence, status, reason,
           source, policy, rule
    FROM ({sk.model_sql()})
""")
def policy_filter(spark, sf_dir):
    m = cm.model_detections(spark, sf_dir)
    return dt.with_det_id(m).select(*dt.DETECTION_COLUMNS)


def _custom_src_sql() -> str:
    return """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '["email", "card_number"]'
                               WHEN doc_id % 3 = 1 THEN '[]' ELSE 'not json' END AS custom_labels FROM documents"""


@register("custom_labels", f"""
    SELECT r.doc_id, r.label, r.char_start, r.char_end, d.policy, p.threshold
    FROM ({sk.standin_sql()}) r
    JOIN ({sk.doc_policy_sql()}) d ON r.doc_id = d.doc_id
    JOIN ({_custom_src_sql()}) c ON c.doc_id = r.doc_id
    JOIN ({sk.policies_sql()}) p ON p.policy = CASE WHEN d.policy IN (SELECT policy FROM ({sk.policies_sql()})) THEN d.policy ELSE 'mixed_general' END
    WHERE list_contains(CASE WHEN c.doc_id % 3 = 0 THEN ['email', 'card_number'] ELSE p.labels END, r.label)
      AND r.score >= p.threshold
""")
def custom_labels(spark, sf_dir):
    """A non-empty custom label list replaces the policy labels; empty
    list or bad JSON keeps them; threshold stays the policy's."""
    docs = cm.documents(spark, sf_dir)
    custom = docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit('["email", "card_number"]'))
                         .when(F.pmod("doc_id", F.lit(3)) == 1, F.lit("[]")).otherwise(F.lit("not json"))
                         .alias("custom_labels"))
    dp = cm.doc_policies(spark, sf_dir).join(custom, "doc_id")
    resolved = dt.resolve_policies(dp)
    raw = dt.standin_raw_entities(docs)
    j = raw.join(resolved, "doc_id").filter(F.array_contains("labels", F.col("label")) & (F.col("score") >= F.col("threshold")))
    return j.select("doc_id", "label", "char_start", "char_end", "policy", "threshold")


def _taxonomy_sql() -> str:
    rows = ", ".join(f"({sk.q(l)}, {sk.q(g)})" for g, ls in tb.TAXONOMY_GROUPS.items() for l in ls)
    return f"SELECT * FROM (VALUES {rows}) AS t(label, label_group)"


@register("taxonomy_rollup", f"""
    SELECT coalesce(t.label_group, 'unknown') AS label_group, count(*) AS n_entities, count(DISTINCT r.doc_id) AS n_docs
    FROM ({sk.standin_sql()}) r LEFT JOIN ({_taxonomy_sql()}) t ON r.label = t.label
    GROUP BY 1
""")
def taxonomy_rollup(spark, sf_dir):
    return dt.label_groups(spark, dt.standin_raw_entities(cm.documents(spark, sf_dir)))


@register("model_reason", f"""
    SELECT doc_id, char_start, type, reason FROM ({sk.model_sql()})
""")
def model_reason(spark, sf_dir):
    return cm.model_detections(spark, sf_dir).select("doc_id", "char_start", "type", "reason")


def _model_and_heur(spark, sf_dir):
    docs = cm.documents(spark, sf_dir)
    raw = dt.standin_raw_entities(docs, with_context=True)
    model = dt.policy_filter(raw, dt.resolve_policies(cm.doc_policies(spark, sf_dir)))
    heur = dt.heuristic_detections(docs, with_context=True)
    return model, heur


_MERGED_COLS = ["doc_id", "char_start", "char_end", "type", "confidence", "status", "reason", "source", "policy", "rule"]


@register("merge_sources", f"WITH {sk.merged_sql()} SELECT {', '.join(_MERGED_COLS)} FROM MG")
def merge_sources(spark, sf_dir):
    """Model spans absorb overlapping heuristic spans; the rest are appended."""
    model, heur = _model_and_heur(spark, sf_dir)
    return dt.merge_sources(model, heur).select(*_MERGED_COLS)


_ALIGNED_COLS = ["doc_id", "pre_start", "char_start", "char_end", "text", "type", "source"]


@register("align_words", f"WITH {sk.merged_sql()}, {sk.aligned_sql('MG')} SELECT {', '.join(_ALIGNED_COLS)} FROM AL")
def align_words(spark, sf_dir):
    """Merged spans expanded to token boundaries, trailing punctuation dropped."""
    model, heur = _model_and_heur(spark, sf_dir)
    return dt.align_words(dt.merge_sources(model, heur)).select(*_ALIGNED_COLS)


_UNION_SRC_SQL = f"""
    U AS (SELECT r.doc_id, r.char_start, r.char_end, upper(r.label) AS type, r.score AS confidence,
                 'missed' AS status, '' AS reason, 'model' AS source, NULL AS policy, NULL AS rule, 0 AS grp,
                 row_number() OVER (PARTITION BY r.doc_id ORDER BY r.char_start, r.char_end, r.label) AS ord, d.text AS doc
          FROM ({sk.standin_sql()}) r JOIN documents d ON r.doc_id = d.doc_id
          UNION ALL
          SELECT h.doc_id, h.char_start, h.char_end, h.type, h.confidence, h.status, h.reason, h.source, NULL, NULL, 1,
                 h.h_rank, d.text
          FROM ({sk.heuristic_sql()}) h JOIN documents d ON h.doc_id = d.doc_id)
"""


@register("merge_overlaps", f"""WITH {_UNION_SRC_SQL}, {sk.islands_sql('U', 'grp, ord')}
    SELECT doc_id, char_start, char_end, type, confidence, status, source, text FROM FI""")
def merge_overlaps(spark, sf_dir):
    """C14 on raw candidate spans of both sources: transitive union of strict overlaps."""
    docs = cm.documents(spark, sf_dir)
    raw = dt.standin_raw_entities(docs)
    w = F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start", "char_end", "label"))
    model = raw.select("doc_id", "char_start", "char_end", F.upper("label").alias("type"),
                       F.col("score").alias("confidence"), F.lit("missed").alias("status"),
                       F.lit("model").alias("source"), "text", F.lit(0).alias("grp"), w.cast("bigint").alias("ord"))
    heur = dt.heuristic_detections(docs).select("doc_id", "char_start", "char_end", "type", "confidence", "status",
                                                "source", "text", F.lit(1).alias("grp"), F.col("h_rank").alias("ord"))
    return dt.merge_overlaps(model.unionByName(heur), ("grp", "ord")).select(
        "doc_id", "char_start", "char_end", "type", "confidence", "status", "source", "text")


@register("detect_pipeline", f"WITH {sk.pipeline_sql()} SELECT * FROM DET")
def detect_pipeline(spark, sf_dir):
    """C17: model + patterns, merge, align, union -> final detections."""
    return cm.detections(spark, sf_dir)


def banded_reason(type_, conf):
    """C11: three-band reason: type template (or default) + band suffix."""
    base = F.coalesce(sp.safe_lookup(tb.REASON_TEMPLATES, type_), F.concat(F.lit(tb.REASON_DEFAULT_PREFIX), type_))
    suffix = (F.when(conf >= 0.85, F.lit(tb.REASON_BAND_SUFFIX["high"]))
              .when(conf >= 0.50, F.lit(tb.REASON_BAND_SUFFIX["medium"]))
              .otherwise(F.lit(tb.REASON_BAND_SUFFIX["low"])))
    status = F.when(conf >= 0.85, "redacted").when(conf >= 0.50, "missed").otherwise("fp")
    return F.concat(base, suffix), status


def _banded_sql() -> str:
    base = f"coalesce({sk.case_map_sql(tb.REASON_TEMPLATES, 'type')}, {sk.q(tb.REASON_DEFAULT_PREFIX)} || type)"
    sfx = tb.REASON_BAND_SUFFIX
    return f"""{base} || CASE WHEN confidence >= 0.85 THEN {sk.q(sfx['high'])} WHEN confidence >= 0.5 THEN {sk.q(sfx['medium'])}
                             ELSE {sk.q(sfx['low'])} END"""


@register("banded_reason", f"""WITH {sk.pipeline_sql()},
    X AS (SELECT doc_id, det_id, type, confidence FROM DET
          UNION ALL SELECT doc_id, 'raw-' || CAST(char_start AS VARCHAR), upper(label), score FROM ({sk.standin_sql()}))
    SELECT doc_id, det_id, {_banded_sql()} AS banded_reason,
           CASE WHEN confidence >= 0.85 THEN 'redacted' WHEN confidence >= 0.5 THEN 'missed' ELSE 'fp' END AS banded_status
    FROM X""")
def banded_reason_q(spark, sf_dir):
    """C11: three-band reason text and status (high / medium / low = 'fp')
    for final detections and raw candidates (all three bands occur)."""
    d = cm.detections(spark, sf_dir).select("doc_id", "det_id", "type", "confidence")
    raw = dt.standin_raw_entities(cm.documents(spark, sf_dir)).select(
        "doc_id", F.concat(F.lit("raw-"), F.col("char_start").cast("string")).alias("det_id"),
        F.upper("label").alias("type"), F.col("score").alias("confidence"))
    x = d.unionByName(raw)
    reason, status = banded_reason(F.col("type"), F.col("confidence"))
    return x.select("doc_id", "det_id", reason.alias("banded_reason"), status.alias("banded_status"))


def _modes_json(batch):
    """Upload form per batch of 10 documents: position 0 anonymize, the file
    of position 3 by name highlight_red, position 5 an empty mode."""
    return F.concat(F.lit('{"0": "anonymize", "5": "", "doc_'), (batch * 10 + 3).cast("string"),
                    F.lit('.txt": "highlight_red"}'))


@register("action_mode", f"""WITH {sk.pipeline_sql()},
    DM AS (SELECT doc_id, doc_id % 10 AS idx, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
                  '{{"0": "anonymize", "5": "", "doc_' || CAST((doc_id // 10) * 10 + 3 AS VARCHAR) || '.txt": "highlight_red"}}' AS modes
           FROM documents),
    AMODE AS (SELECT doc_id, coalesce(nullif(json_extract_string(modes, '$."' || CAST(idx AS VARCHAR) || '"'), ''),
                                  nullif(json_extract_string(modes, '$."' || filename || '"'), ''), 'redact') AS mode FROM DM)
    SELECT d.doc_id, d.det_id, m.mode AS action_mode FROM DET d JOIN AMODE m ON m.doc_id = d.doc_id""")
def action_mode(spark, sf_dir):
    """Each detection takes its document's mode: by upload position,
    then by file name, then 'redact' (empty modes fall through)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    modes = F.from_json(_modes_json(F.floor(F.col("doc_id") / 10)), "map<string,string>")
    idx = F.pmod(F.col("doc_id"), F.lit(10)).cast("string")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    pick = lambda k: F.nullif(F.element_at(modes, k), F.lit(""))
    dm = docs.select("doc_id", F.coalesce(pick(idx), pick(name), F.lit("redact")).alias("action_mode"))
    return cm.detections(spark, sf_dir).select("doc_id", "det_id").join(dm, "doc_id")


#: one pattern for each benchmark item: its first two words of three letters and more, and the rest of the second one's line of letters
_TABLE_SQL = """PT AS (SELECT item_id AS pattern_id, regexp_extract(text, '[A-Za-z]{3,} [A-Za-z]{3,}', 0) AS lit FROM benchmark)"""


@register("detect_pattern_table", f"""WITH {_TABLE_SQL},
    H AS (SELECT d.doc_id, p.pattern_id, string_split_regex(d.text, p.lit || '[a-z]* [a-z]+') AS parts, regexp_extract_all(d.text, p.lit || '[a-z]* [a-z]+') AS ms
          FROM documents d JOIN PT p ON p.lit <> '' AND contains(d.text, p.lit)),
    S AS (SELECT doc_id, pattern_id, CAST(i - 1 AS INTEGER) AS match_idx, ms[i] AS text,
                 CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS char_start
          FROM H, unnest(generate_series(1, len(ms))) AS t(i))
    SELECT doc_id, pattern_id, match_idx, char_start, char_start + length(text) AS char_end, text, 'ITEM' AS type, CAST(0.9 AS DOUBLE) AS confidence FROM S""")
def detect_pattern_table(spark, sf_dir):
    """User patterns from a table, one for each benchmark item, all looked for in one pass over each document."""
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.regexp_extract("text", "[A-Za-z]{3,} [A-Za-z]{3,}", 0).alias("lit"))
    table = items.filter("lit <> ''").select("pattern_id", F.lit("item").alias("name"), F.concat("lit", F.lit("[a-z]* [a-z]+")).alias("regex"),
                                             F.lit("ITEM").alias("type"), F.lit(0.9).alias("confidence"), F.lit("").alias("reason"))
    ids = table.select("pattern_id", (F.row_number().over(Window.orderBy("pattern_id")) - 1).alias("pat_idx"))  # a pattern table is small by contract
    found = dt.table_spans(cm.documents(spark, sf_dir), table)
    return found.join(F.broadcast(ids), "pat_idx").select("doc_id", "pattern_id", "match_idx", "char_start", "char_end", "text", "type", F.col("base_conf").alias("confidence"))
