"""Collocations against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanveil.llm import collocations, shingles
from spanveil.llm.byte_words import byte_class, span_hashes, spans

SCHEMA = "text string, lang string, `a.b` int, Phrase string, score int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def brute(rows, least, first):
    counts, totals = counted(rows)
    candidates = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    out = []
    for lang in totals:
        mine = []
        for (of, p), a in candidates.items():
            if of != lang or any(o == lang and len(q) > len(p) and c >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
                                 for (o, q), c in candidates.items()):
                continue
            score, cut = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]], cut))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s, cut) for i, (s, a, p, left, right, cut) in enumerate(sorted(mine)[:first])]
    return sorted(out)


def table(n=300, seed=3):
    r = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "été", "of", "x y", "<|", "longer", "same"]
    rows = []
    for _ in range(n):
        words = r.choices(vocabulary, k=r.choice([0, 1, 3, 30]))
        rows.append(("".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r"]) for w in words), r.choice(["en", "en", "en", "é", None, "und"])))
    rows += [("of the same old, of the same old! " * 40, "en")] * 3 + [(None, "en"), ("", None), ("a a a a a a a", "en"), (" \t ", "only blanks"), ("word " * 3000, "hot")]
    return rows


@pytest.mark.parametrize(("bits", "first"), [(64, 2000), (9, 2000), (64, 7)])
def test_collocations(spark, bits, first):
    rows = table()
    df = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], SCHEMA).repartition(5)
    got = collocations.collocations(df, least=10, first=first, salts=3, bits=bits).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, first)
    assert len(got) >= 20


def test_collocations_of_nothing(spark):
    out = collocations.collocations(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    assert collocations.collocations(spark.createDataFrame([("a b", "en", 1, "", 1)], SCHEMA)).count() == 0


class _All:
    value = [np.full(1 << 10, 255, np.uint8)] * 5


def test_long_texts_in_pieces(monkeypatch):
    """A text cut into many pieces gives the counts of the whole text, each n-gram once."""
    monkeypatch.setattr(shingles, "PIECE", 64)
    r = random.Random(1)
    long = "".join(r.choice(["alpha ", "b ", "c\t", "d", ". ", "été ", "x" * 90 + " "]) for _ in range(3000))
    rows = [("a b", "en"), (long, "en"), (None, "de"), (long[:500], None), ("", "en")]
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if g is None else g for _, g in rows]), pa.array([t for t, _ in rows])], names=["lang", "text"])
    found, words = Counter(), Counter()
    for part in collocations._phrase_pass(_All, 64)(iter([batch])):
        for lang, n, phrase, c in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if n:
                assert len(phrase.split(" ")) == n
                found[lang, tuple(phrase.split(" "))] += c
            else:
                words[lang] += c
    counts, totals = counted(rows)
    assert found == counts and words == +totals


def test_hashes_follow_bytes():
    data = np.frombuffer("ab cd ab Ab abc ab".encode(), np.uint8)
    start, end = spans(~byte_class(" ")[data], np.zeros(len(data), bool))
    for second in (False, True):
        h = span_hashes(data, start, end, second)
        assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 4
