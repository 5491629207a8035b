"""Pattern detector (C1-C3, C5) against Python's re on inline rows."""

import re

from pyspark.sql import functions as F

from spanveil.functions import spans as sp
from spanveil.functions import tables as tb
from spanveil.operators import detect as dt


def _spans(spark, texts, pattern):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in dt.pattern_spans(df, [("p", pattern, "T", 0.9, "")]).orderBy("doc_id", "match_idx").collect():
        out[r.doc_id].append((r.char_start, r.char_end, r.text))
    return out


def _py(texts, pattern):
    rx = re.compile(pattern)
    return {i: [(m.start(), m.end(), m.group()) for m in rx.finditer(t)] for i, t in enumerate(texts)}


PHONE = tb.HEURISTIC_PATTERNS[0][1]
EMAIL = tb.HEURISTIC_PATTERNS[1][1]
IPV4 = tb.HEURISTIC_PATTERNS[2][1]
IPV6 = tb.HEURISTIC_PATTERNS[3][1]


def test_phone_quirks(spark):
    texts = ["call +919876543210 now", "call +91 9876543210 now", "call +91-9876543210 now",
             "9876543210", "19876543210", "5876543210", "a 9876543210, b 7000000000"]
    got = _spans(spark, texts, PHONE)
    assert got == _py(texts, PHONE)
    assert got[0] == [] and got[1][0][2] == "+91 9876543210" and got[4] == [] and got[5] == []


def test_ipv6_quirks(spark):
    texts = ["addr fe80::1 end", "::1", "x::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    got = _spans(spark, texts, IPV6)
    assert got == _py(texts, IPV6)
    assert got[0][0][2] == "fe80::" and got[1] == [] and got[2][0][2] == "::1"


def test_ipv4_octets(spark):
    texts = ["256.1.1.1", "0.0.0.0 and 255.255.255.255", "10.0.0.1."]
    got = _spans(spark, texts, IPV4)
    assert got == _py(texts, IPV4)
    assert [m for _, _, m in got[1]] == ["0.0.0.0", "255.255.255.255"]


def test_email_unicode_offsets(spark):
    texts = ["\U0001F600 mail a.b@x-y.org!", "é john@example.com", "pipe a|b@c.io"]
    got = _spans(spark, texts, EMAIL)
    assert got == _py(texts, EMAIL)
    assert got[0][0][0] == 7


def test_extended_pack_bands(spark):
    df = spark.createDataFrame([(1, "PAN ABCDE1234F id 1234 5678 9012 born 12/03/1990")], "doc_id long, text string")
    h = dt.heuristic_detections(df, tb.EXTENDED_PATTERNS).collect()
    by_type = {r.type: r for r in h}
    assert by_type["PAN"].text == "ABCDE1234F" and by_type["PAN"].status == "redacted"
    assert by_type["AADHAAR"].text == "1234 5678 9012"
    assert by_type["DATE"].status == "missed" and by_type["DATE"].confidence == 0.60


def test_min_length_and_reason(spark):
    df = spark.createDataFrame([(1, "x 10.0.0.1 y")], "doc_id long, text string")
    r = dt.heuristic_detections(df).collect()
    assert len(r) == 1 and r[0].reason.startswith("[Heuristic] ") and r[0].source == "heuristic"


TABLE = "pattern_id long, name string, regex string, type string, confidence double, reason string"


def test_longest_literal():
    from spanveil.functions.docspans import longest_literal
    cases = {r"token = \"[0-9a-f]+\"": 'token = "', r"(?:ab)+cd": "ab", r"a|b": "", r"(?i)abc": "", r"x(yz)w[0-9]": "xyzw", r"[ab]c?d": "d", r"(ab|cd)ef": "ef", r"\bfoo\b": "foo",
             r"a{2}b": "a", r"(?=abc)d": "d", r"(?i:abc)d": "d"}
    assert {k: longest_literal(k) for k in cases} == cases


def test_pattern_table_equals_single_patterns(spark):
    """Hundreds of patterns from a table give what each gives alone; patterns without a literal are tried everywhere."""
    import random
    r = random.Random(5)
    words = ["".join(r.choices("abcde", k=r.randint(2, 4))) for _ in range(120)]
    regexes = [w + r.choice(["", "[a-e]*", r"\b", " [a-e]+", "(x|y)?"]) for w in words] + [r"[0-9]{3}", r"(?i)ABC", r"(?<!a)bcd", r"a\sb+", r"été"]
    texts = [" ".join(r.choices(words + ["123", "é", "été abc", "\n"], k=60)) for _ in range(80)] + ["", "abc" * 500, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(i, f"p{i}", x, "T", 0.9, None) for i, x in enumerate(regexes)], TABLE)
    got = sorted((x.doc_id, x.pat_idx, x.match_idx, x.char_start, x.char_end) for x in dt.table_spans(docs, table).collect())
    want = sorted((i, p, j, m.start(), m.end()) for i, t in enumerate(texts) if t for p, x in enumerate(regexes) for j, m in enumerate(re.finditer(x, t))
                  if len(m.group().strip()) >= tb.HEURISTIC_MIN_TRIMMED_LENGTH)
    assert got == want and len(got) > 1000


def test_unusable_patterns_are_named(spark):
    import pytest
    table = spark.createDataFrame([(1, "a", "ok", "T", 0.9, None), (2, "b", "(", "T", 0.9, None), (3, "c", "x*", "T", 0.9, None), (4, "d", None, "T", 0.9, None)], TABLE)
    with pytest.raises(ValueError, match=r"\[2, 3, 4\]"):
        dt.pattern_rows(table)


def test_many_patterns_cost_little_more_than_few():
    """One pass of the automaton, not one per pattern: 500 patterns cost a small multiple of 4 (about 4 times; 125 times as many)."""
    import random
    import time
    from spanveil.functions.docspans import AutomatonMatcher
    r = random.Random(9)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(300_000))
    regexes = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) + r"[a-z]*\b" for _ in range(500)]

    def seconds(many):
        found, best = AutomatonMatcher(regexes[:many]), 1e9
        for _ in range(3):
            start = time.perf_counter()
            for _ in found.find(text):
                pass
            best = min(best, time.perf_counter() - start)
        return best
    assert seconds(500) <= 12 * seconds(4)
