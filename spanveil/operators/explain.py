"""Explanations for any word, flagged or not.

Rule texts are fixed templates filled with built-in string functions; the
word-to-detection lookup is an interval join with the equi key doc_id.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..functions import tables as tb


def fill(template: str, **vals: Column) -> Column:
    """Template with {name} holes -> concat of literals and columns."""
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in vals if rest.find("{" + k + "}") >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        pos, key = min(hits)
        if pos:
            parts.append(F.lit(rest[:pos]))
        parts.append(vals[key])
        rest = rest[pos + len(key) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def lowered(word: Column) -> Column:
    """The word in lower case without blanks at its ends (few words have any, so the replacement is seldom tried)."""
    return F.lower(F.when(word.rlike(r"\s"), F.regexp_replace(word, r"^\s+|\s+$", "")).otherwise(word))


def lowered_rule(low: Column) -> Column:
    """``unflagged_rule`` of a word that ``lowered`` gave."""
    # equality with a legal term is covered by containment
    return (F.when(F.length(low) <= 2, "short")
            .when(reduce(or_, [low.contains(t) for t in tb.LEGAL_TERMS]), "legal")
            .when(low.isin(*tb.FUNCTION_WORDS), "function")
            .when((F.length(low) <= 4) & low.rlike("^[0-9]+$"), "number")
            .otherwise("default"))


def unflagged_rule(word: Column) -> Column:
    """E4 rule name, first match wins: short, legal, function, number, default."""
    return lowered_rule(lowered(word))


def unflagged_explanation(word: Column, rule: Column) -> tuple[Column, Column]:
    """(explanation, risk_level) for a word that overlaps no detection."""
    n = F.length(lowered(word)).cast("string")
    text = (F.when(rule == "short", fill(tb.EXPLAIN_SHORT, t=word))
            .when(rule == "legal", fill(tb.EXPLAIN_LEGAL, t=word))
            .when(rule == "function", fill(tb.EXPLAIN_FUNCTION, t=word))
            .when(rule == "number", fill(tb.EXPLAIN_NUMBER, t=word, n=n))
            .otherwise(fill(tb.EXPLAIN_DEFAULT, t=word)))
    risk = F.when(rule == "number", F.lit("low")).otherwise(F.lit("none"))
    return text, risk


def flagged_explanation(text: Column, type_: Column, conf: Column, reason: Column) -> Column:
    """Rule explanation for a flagged selection (description by type,
    confidence note by band, detection basis appended when a reason exists).
    A null or zero confidence reads 'unknown' and counts as low."""
    desc = F.coalesce(sp.safe_lookup(tb.PII_DESCRIPTIONS, type_), F.concat(F.lit("data classified as "), type_))
    has = conf.isNotNull() & (conf != 0)
    pct = F.when(has, sp.pct0(conf)).otherwise(F.lit("unknown"))
    note = (F.when(has & (conf >= 0.85), fill(tb.CONF_NOTE_HIGH, pct=pct))
            .when(has & (conf >= 0.50), fill(tb.CONF_NOTE_MEDIUM, pct=pct))
            .otherwise(fill(tb.CONF_NOTE_LOW, pct=pct)))
    base = F.concat(F.lit('"'), text, F.lit('" was identified as '), desc, F.lit(". "), note)
    return F.when(F.coalesce(F.length(reason), F.lit(0)) > 0,
                  F.concat(base, F.lit(" Detection basis: "), reason)).otherwise(base)


def explain_words(words: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """E1+E2+E5: flagged words explain from the stored detection ('cached');
    others from an external explanation table when given (source as named
    there), else from the rules ('rules').

    ``words`` comes from ``structure.words_with_detections``: the lookup of a word's detection, and of its external
    explanation if the words were made with them (column ``ext``), is done in the document's row, so no word is
    shuffled.  Words made without them may be given ``external`` (doc_id, word_idx, explanation, risk_level, source) here, which
    shuffles every word.
    """
    if "ext" in words.columns:
        x = words.select("*", F.col("ext.explanation").alias("_ext"), F.col("ext.risk_level").alias("_erisk"),
                         F.col("ext.source").alias("_esrc")).drop("ext")
    elif external is not None:
        x = words.join(external.select("doc_id", "word_idx", F.col("explanation").alias("_ext"),
                                       F.col("risk_level").alias("_erisk"), F.col("source").alias("_esrc")),
                       ["doc_id", "word_idx"], "left")
    else:
        x = words.select("*", F.lit(None).cast("string").alias("_ext"), F.lit(None).cast("string").alias("_erisk"),
                         F.lit(None).cast("string").alias("_esrc"))
    is_det = F.col("det").isNotNull()
    # the lowered word and the rule are computed in projections of their own and referenced by name
    x = x.withColumn("_low", lowered(F.col("word")))
    x = x.withColumn("rule", F.when(is_det, F.lit("detection")).when(F.col("_ext").isNotNull(), F.lit("external"))
                     .otherwise(lowered_rule(F.col("_low"))))
    conf = F.coalesce(F.col("det.confidence"), F.lit(0.0))
    cached = F.coalesce(F.col("det.reason"), F.concat(F.lit("Detected as "), F.coalesce(F.col("det.type"), F.lit("UNKNOWN")),
                                                      F.lit(" with "), sp.pct0(conf), F.lit(" confidence.")))
    rule = F.col("rule")
    rtext, rrisk = unflagged_explanation(F.col("word"), rule)
    key = sp.det_id(F.col("doc_id"), F.col("det.char_start"), F.col("det.char_end"), F.col("det.type"))
    return x.select(
        "doc_id", "word_idx", "char_start", "char_end", "word",
        is_det.alias("is_detection"), F.when(is_det, key).alias("det_id"),
        F.when(is_det, F.lit("cached")).when(rule == "external", F.col("_esrc")).otherwise(F.lit("rules")).alias("source"),
        rule,
        F.when(is_det, sp.risk_level(conf)).when(rule == "external", F.col("_erisk")).otherwise(rrisk).alias("risk_level"),
        F.when(is_det, cached).when(rule == "external", F.col("_ext")).otherwise(rtext).alias("explanation"))
