"""Column expressions for character-span arithmetic.

All offsets are 0-based, half-open and counted in code points (Spark's
``length`` / ``substring`` semantics).  Every function here returns a
``Column`` built only from built-in Spark SQL functions, so the plans stay
inside Catalyst and whole-stage code generation where Spark supports it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as tb

SPAN_TYPE = "array<struct<s:int,e:int,m:string>>"


def sql_lit(s: str) -> str:
    """Spark SQL string literal that keeps backslashes (raw literal)."""
    if "'" not in s:
        return "r'" + s + "'"
    if '"' not in s:
        return 'r"' + s + '"'
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def required_literals(pattern: str) -> list[str]:
    """Literal characters every match of ``pattern`` must contain: a cheap
    byte search (no regex, no string conversion) skips most texts before the
    regex runs.  Only top-level characters outside groups, classes,
    alternations and optional parts are used, so the result is always safe."""
    if "|" in pattern.replace("\\|", ""):
        # alternation anywhere (also inside classes like [A-Z|a-z]): only keep
        # literals when the pipe is inside a character class
        depth, in_cls, esc = 0, False, False
        for ch in pattern:
            if esc:
                esc = False
            elif ch == "\\":
                esc = True
            elif in_cls:
                in_cls = ch != "]"
            elif ch == "[":
                in_cls = True
            elif ch == "|":
                return []
    out, depth, in_cls, esc, i = [], 0, False, False, 0
    while i < len(pattern):
        ch = pattern[i]
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        if esc:
            esc = False
            if ch in "+().[]{}?*^$|\\/\"'@:=- " and depth == 0 and nxt not in "?*{":
                out.append(ch)
        elif ch == "\\":
            esc = True
        elif in_cls:
            in_cls = ch != "]"
        elif ch == "[":
            in_cls = True
        elif ch == "{":
            i = pattern.find("}", i)
            if i < 0:
                return []
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif depth == 0 and ch not in ".^$*+?{}|" and nxt not in "?*{" and (ch.isalnum() is False or ch in "@:=\"' "):
            if ch not in "0123456789":
                out.append(ch)
        i += 1
    return sorted(set(x for x in out if x not in ("\\",)))


def regex_spans_sql(text: str, pattern: str) -> str:
    """SQL text of array<struct<s int, e int, m string>>: the leftmost, non-overlapping matches in a short
    text (a column name or SQL expression), with their offsets.

    ``regexp_extract_all`` yields the matched strings and ``split`` with the
    same regex the gaps between them; walking both arrays once gives the
    offsets.  The fold copies its result at each step: for the few tokens around a span, not for
    documents (``operators.detect.pattern_spans``).
    """
    p = sql_lit(pattern)
    lits = required_literals(pattern)
    guard = " AND ".join([f"contains({text}, {sql_lit(x)})" for x in lits] + [f"{text} RLIKE {p}"])
    return f"""(CASE WHEN {guard} THEN aggregate(
        zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (_g, _m) -> named_struct('g', _g, 'm', _m)),
        named_struct('pos', 0, 'out', CAST(array() AS {SPAN_TYPE})),
        (_acc, _x) -> CASE WHEN _x.m IS NULL THEN _acc ELSE named_struct(
            'pos', _acc.pos + length(_x.g) + length(_x.m),
            'out', array_append(_acc.out, named_struct('s', _acc.pos + length(_x.g),
                                                       'e', _acc.pos + length(_x.g) + length(_x.m), 'm', _x.m))) END,
        _acc -> _acc.out)
      ELSE CAST(array() AS {SPAN_TYPE}) END)"""


def cut(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with 0-based half-open offsets."""
    return F.when(end > start, text.substr(start + 1, end - start)).otherwise(F.lit(""))


DET_ID_SQL = ("substring(sha2(concat_ws('|', CAST(doc_id AS STRING), CAST(char_start AS STRING), "
              "CAST(char_end AS STRING), type), 256), 1, 16)")


def det_id(doc_id: Column, start: Column, end: Column, type_: Column) -> Column:
    """Deterministic detection id: first 16 hex chars of sha256(doc|start|end|type)."""
    return F.substring(F.sha2(F.concat_ws("|", doc_id.cast("string"), start.cast("string"),
                                           end.cast("string"), type_), 256), 1, 16)


def heuristic_status(conf: Column) -> Column:
    return (F.when(conf >= tb.REDACT_AT, "redacted")
            .when(conf >= tb.REVIEW_AT, "missed")
            .otherwise("false_positive"))


def model_status(conf: Column) -> Column:
    return F.when(conf >= tb.REDACT_AT, "redacted").otherwise("missed")


def risk_level(conf: Column) -> Column:
    c = F.coalesce(conf, F.lit(0.0))
    return F.when(c >= 0.85, "high").when(c >= 0.5, "medium").otherwise("low")


def pct0(conf: Column) -> Column:
    """Percentage without decimals, e.g. 0.97 -> '97%' (half-even like printf)."""
    return F.concat(F.bround(conf * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def map_lookup(mapping: dict, key: Column) -> Column:
    """Lookup in a fixed Python dict as a literal MapType (no join needed)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key) \
        if mapping else F.lit(None).cast("string")


def safe_lookup(mapping: dict, key: Column) -> Column:
    """Like ``map_lookup`` but null keys and absent keys both give null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(key.isNull(), F.lit(None).cast("string")).otherwise(F.try_element_at(m, key))
