"""Words in arrays of a batch against Python's re, one text at a time."""

import random
import re

from pyspark.sql import functions as F

from spanveil.operators import structure as st
from spanveil.session import spread

TEXTS = ["", None, " ", "one", " a  b\tc\n", "été\xa0ça x", "\U0001F600 \U0001F600x y", "\x1c\x1dq\x85r", "x" * 50, "tail "]


def plain(text, dets=()):
    out = []
    for i, m in enumerate(re.finditer(r"\S+", text or "")):
        hit = next((d for d in sorted(dets, key=lambda d: d[0]) if m.start() < d[1] and m.end() > d[0]), None)
        out.append((i, m.start(), m.end(), m.group(), hit and hit[2]))
    return out


def test_word_table_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choices(["a", "é", "\U0001F600", " ", "\n", "　", "bc"], k=r.choice([5, 40, 900]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for x in st.word_table(docs).collect():
        got.setdefault(x.doc_id, []).append((x.word_idx, x.char_start, x.char_end, x.word))
    assert got == {i: [w[:4] for w in plain(t)] for i, t in enumerate(texts) if plain(t)}
    # pieces of any length join without a seam
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(st, "_PIECE", size)
        found, count, last = [], 0, -1
        for group in st._text_pieces(texts):
            place, start, end, words = st._group_words(group)
            found += [(group[p][0], s, e, w) for p, s, e, w in zip(place.tolist(), start.tolist(), end.tolist(), words.to_pylist(), strict=True)]
        assert found == [(i, *w[1:4]) for i, t in enumerate(texts) for w in plain(t)]


def test_words_of_a_very_long_text(spark):
    text = ("word " * 3 + "x" * 20 + "\n") * 100_000  # 3.6 million characters
    docs = spark.createDataFrame([(1, "before it"), (2, text), (3, "after it")], "doc_id long, text string").coalesce(1)
    rows = st.word_table(docs)
    assert rows.groupBy("doc_id").agg(F.count("*"), F.max("word_idx"), F.max("char_end"), F.countDistinct("word_idx")).orderBy("doc_id").collect() == [
        (1, 2, 1, 9, 2), (2, 400_000, 399_999, len(text) - 1, 400_000), (3, 2, 1, 8, 2)]
    assert rows.filter("doc_id = 2").selectExpr(f"max(abs(char_end - char_start - length(word)))").first()[0] == 0


def test_first_detection_of_a_word(spark):
    r = random.Random(4)
    cases = []
    for i in range(80):
        text = "".join(r.choices(["ab", " ", "c", "é"], k=40))
        starts = r.sample(range(len(text)), r.randint(0, 6))
        cases.append((i, text, [(s, s + r.choice([1, 3, 15]), f"t{k}") for k, s in enumerate(starts)]))
    schema = "doc_id long, text string, dets array<struct<text:string,char_start:bigint,char_end:bigint,type:string,confidence:double,reason:string>>"
    rows = [(i, t, [("x", s, e, name, 0.9, None) for s, e, name in d]) for i, t, d in cases] + [(999, "no list", None)]
    got = {}
    for x in st.words_with_detections(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(x.doc_id, []).append((x.word_idx, x.char_start, x.char_end, x.word, x.det and x.det.type))
    want = {i: plain(t, d) for i, t, d in cases if plain(t)} | {999: plain("no list")}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_spread_deals_out_small_tables_only(spark):
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(100).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == 2 * cores and spread(small).count() == 100
    large = spark.range(0, 1000, 1, 4 * cores)
    assert spread(large) is large
