"""Explanation rules."""

from pyspark.sql import functions as F

from spanveil.operators import explain as ex


def test_unflagged_rule_order(spark):
    words = ["a", "hereinafter", "subcontractor", "the", "the,", "1234", "12345", "Zanzibar"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    r = df.select("word", ex.unflagged_rule(F.col("word")).alias("rule")).collect()
    got = {x.word: x.rule for x in r}
    assert got == {"a": "short", "hereinafter": "legal", "subcontractor": "legal", "the": "function",
                   "the,": "default", "1234": "number", "12345": "default", "Zanzibar": "default"}
    text, risk = ex.unflagged_explanation(F.col("word"), ex.unflagged_rule(F.col("word")))
    x = {w.word: (w.t, w.r) for w in df.select("word", text.alias("t"), risk.alias("r")).collect()}
    assert x["1234"][1] == "low" and "4-digit number" in x["1234"][0]
    assert x["the"][0].startswith('"the" is a common English function word')


def test_flagged_explanation(spark):
    df = spark.createDataFrame([("x@y.io", "EMAIL_ADDRESS", 0.97, "why"), ("q", "ZED", 0.0, None),
                                ("p", "PERSON", 0.6, "")], "t string, ty string, c double, r string")
    got = [x.e for x in df.select(ex.flagged_explanation(F.col("t"), F.col("ty"), F.col("c"), F.col("r")).alias("e")).collect()]
    assert got[0] == ('"x@y.io" was identified as an email address — a direct digital identifier. The detection '
                      'confidence is 97% (high), so this was auto-redacted for safety. Detection basis: why')
    assert "data classified as ZED" in got[1] and "unknown (low)" in got[1]
    assert "60% (medium)" in got[2] and "Detection basis" not in got[2]
