"""Matching in pieces equals a single pass over the text."""

import random

import pytest

from spanveil.functions import tables as tb
from spanveil.operators import detect as dt
from spanveil.operators import pieces as pc

#: overlapping choices, looks to both sides, unbounded runs, blanks inside, patterns that only the whole text tells
ODD = [(f"p{i}", p, "T", 0.5 + i / 100, "") for i, p in enumerate([
    r"aaa", r"ab?a{2,5}", r"(?<!b)a[ab]{2,7}(?!a)", r"[ab]+@[ab]+", r"\ba+b@?\b", r"a b a", r"(?<=@)[ab]{3,}", r"a\s+b", r"[ab]{3,}", r"(a)(b)\1b?a$"])]
COLUMNS = ["doc_id", "pat_idx", "match_idx", "char_start", "char_end", "text", "type", "base_conf", "base_reason"]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_what_can_be_split():
    assert all(pc.splits(p) for _, p, *_ in tb.HEURISTIC_PATTERNS + tb.EXTENDED_PATTERNS)
    assert not pc.splits(r"a\s+b") and not pc.splits(r"a(?=.*b)") and pc.splits(r"[a-z]+@")
    assert pc.extent(r"(?<=ab)c{2,5}(?!d)") == (5, 5)


@pytest.mark.parametrize("size", [3, 16])
def test_pieces_equal_one_pass(spark, size):
    rng = random.Random(size)
    texts = ["".join(rng.choices("ab@ \n\U0001F600", (9, 5, 2, k % 4 / 2, 0.2, 0.3), k=rng.randint(0, 90))) for k in range(120)]
    texts += ["a" * 200, "ab" * 70, "a" * 50 + "@" + "b" * 60, " " * 40, "", None, "a b " * 30, "aab@" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(pc.split_spans(docs, ODD, piece_chars=size)) == rows(dt.pattern_spans(docs, ODD))


def test_known_patterns_across_cuts(spark):
    text = " ".join(["mail a.b@x-y.org", "+91-9876543210", "10.0.0.1", "fe80::1", "1234 5678 9012", "01/02/2024", "ABCDE1234F", "é\U0001F600"] * 9)
    docs = spark.createDataFrame([(None, text[k:]) if k == 0 else (k, text[k:]) for k in range(25)], "doc_id long, text string")
    for patterns in (tb.HEURISTIC_PATTERNS, tb.EXTENDED_PATTERNS):
        want = rows(dt.pattern_spans(docs, patterns))
        assert want and rows(pc.split_spans(docs, patterns, piece_chars=11)) == want


def test_a_long_run_without_literals_is_not_carried_along():
    cutter = pc._Cutter([tb.HEURISTIC_PATTERNS[1][1]])
    assert max(high - low for *_, low, high in cutter.windows("a" * 100_000, 1000)) < 1100
    text = "a" * 50_000 + "@" + "a" * 50_000 + ".io"
    assert max(high - low for *_, low, high in cutter.windows(text, 1000)) == len(text)


def test_one_very_long_text_uses_many_tasks(spark):
    unit = "some words without anything, then one mail to user.name@example.org and 10.20.30.40; "
    docs = spark.range(1).selectExpr("id AS doc_id", f"repeat('{unit}', 60000) AS text")
    spans = pc.split_spans(docs, piece_chars=1 << 18)
    assert rows(spans.filter("match_idx % 1000 = 7")) == rows(dt.pattern_spans(docs).filter("match_idx % 1000 = 7"))
    assert spans.count() == 120_000
