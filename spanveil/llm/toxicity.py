"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

The lexicon is learnt from a bounded sample of labelled rows: words and word stems (first
three to six letters) whose texts are nearly all toxic, each with its log odds.  Features are
densities of lexicon hits (as written, and after undoing obfuscation), how near they
stand to a second-person word, and rates of capitals, punctuation and obfuscated words.
Trees and calibration are fitted on numpy features of the same sample; scoring
makes one pass over the whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample_ids, sample_rows, score_rows
from .trees import Boosted, calibrate, isotonic
from .util import col

#: labelled rows fitted on, at most
SAMPLE = 20_000
#: a lexicon entry occurs in so many toxic texts of the sample at least, with such odds against the others
LEAST_TEXTS, LEAST_SHARE = 4, 0.75
MOST_ENTRIES = 4000
STEMS = (3, 4, 5, 6)
#: words of address in the languages of the corpus
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
                          "usted ustedes ti tus su vosotros os".split())
#: characters that stand for letters
LEET = str.maketrans("013457@$!|€", "oieastasile")

_LETTERS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][\d@$!|€*.\-_+]+[^\W\d_]")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\S)")
_NOISE = re.compile(r"[\W_]+")


def plain_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def undo(text: str) -> list[str]:
    """Words that hold a stand-in between letters, and letters spelled apart, written out."""
    found, end = [], 0
    for m in _MIXED.finditer(text):
        if m.start() >= end:
            start = m.start()
            while start > 0 and not text[start - 1].isspace():
                start -= 1
            end = m.end()
            while end < len(text) and not text[end].isspace():
                end += 1
            found.append(_NOISE.sub("", text[start:end].lower().translate(LEET)))
    found += [_NOISE.sub("", m.group().lower()) for m in _SPELLED.finditer(text)]
    return [w for w in found if len(w) > 2]


def entries_of(word: str) -> list[str]:
    """The word itself (=word) and its stems (word-)."""
    return ["=" + word] + [word[:n] + "-" for n in STEMS if len(word) > n]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entry -> log odds, from (y, text) rows of the bounded sample; counted on the executors."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {e for w in set(plain_words(text or "")) for e in entries_of(w)}
                (toxic if y else other).update(seen)
            keys = list(toxic | other)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                                              pa.array([other[k] for k in keys], pa.int64())], names=["entry", "a", "b"])
    counts = sample.select("y", "text").mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counts.filter(f"a >= {LEAST_TEXTS} AND a >= {LEAST_SHARE} * (a + b)").withColumn(
        "odds", F.expr("ln((a + 0.5) / (b + 0.5))")).orderBy(F.desc("odds"), F.desc("a"), "entry").limit(MOST_ENTRIES)
    return {r["entry"]: float(r["odds"]) for r in best.collect()}


class Odds(dict):
    """Word -> log odds of its strongest entry (0 without one), kept for words met before."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = max((self.lexicon.get(e, 0.0) for e in entries_of(word)), default=0.0)
        return found


def _nearest(hits: list[int], you: list[int]) -> np.ndarray:
    """The distance from each hit to the nearest of ``you`` (both ascending)."""
    h, y = np.array(hits), np.array(you)
    after = np.searchsorted(y, h)
    return np.minimum(np.abs(h - y[np.maximum(after - 1, 0)]), np.abs(y[np.minimum(after, len(y) - 1)] - h))


def features(text: str | None, odds: Odds) -> list[float]:
    text = text or ""
    words = plain_words(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    strength = list(map(odds.__getitem__, words))
    hits = [i for i, s in enumerate(strength) if s] if any(strength) else []
    strength = [strength[i] for i in hits]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = _nearest(hits, you) if you else np.empty(0)
    hidden = undo(text)
    hidden_hits = [s for s in map(odds.__getitem__, hidden) if s]
    letters = sum(map(len, words))
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    return [
        len(hits), len(hits) / n, len({words[i] for i in hits}), max(strength, default=0.0), sum(strength), sum(strength) / n,
        sum(1 for i in hits if "=" + words[i] in odds.lexicon), len(hidden_hits), max(hidden_hits, default=0.0), len(hidden) / n,
        float((1 / (1 + near)).sum()), int((near <= 3).sum()), len(you) / n,
        seen[65:91].sum() / chars, (seen[33] + seen[63]) / chars, (chars - letters - seen[32]) / chars, letters / n, float(np.log1p(n)),
    ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    boosted: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(calibrate(self.knots, self.boosted.raw(x)), 0.0, 1.0)


def _feature_rows(sample: DataFrame, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = Odds(lexicon)
        for batch in batches:
            x = [features(t, odds) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])
    rows = sample.select(F.col("id").cast("string").alias("id"), "y", "text").mapInArrow(make, "id string, y int, x array<double>").toPandas()
    rows = rows.sort_values(["id", "y"], kind="stable")
    return rows["id"].to_numpy(), rows["y"].to_numpy(dtype=float), np.array(rows["x"].to_list(), dtype=float).reshape(len(rows), -1 if len(rows) else 0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held_out: int = 0, limit: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from at most ``limit`` labelled rows whose crc32(id) mod ``mod`` is not ``held_out``.

    Only the sample's features (18 numbers a row) come to the driver.  A quarter of the sample is
    left out of the trees and calibrates them; the lexicon is learnt from the other
    three quarters, too, so that its hits are not taken for surer than they are.  Without labels of both kinds every score is 0.
    """
    sample = sample_rows(docs.select(col(id_col), col(text_col).alias("text")), sample_ids(labels, label, mod, held_out, limit), id_col)
    fold = F.pmod(F.xxhash64("id"), F.lit(4))
    lexicon = learn_lexicon(sample.filter(fold != 0))
    _, y, x = _feature_rows(sample.filter(fold != 0), lexicon)
    _, cy, cx = _feature_rows(sample.filter(fold == 0), lexicon)
    if len(set(y)) < 2:
        return ToxicityModel({}, Boosted(rounds=0), (np.zeros(1), np.zeros(1)))
    boosted = Boosted().fit(x, y)
    knots = isotonic(boosted.raw(cx), cy) if len(set(cy)) == 2 else isotonic(boosted.raw(x), y)
    return ToxicityModel(lexicon, boosted, knots)


def score_documents(df: DataFrame, model: ToxicityModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with score (0 to 1): null and empty texts get the score of a text without words; each row
    by itself, so repeated rows agree.  An input column named score (in any case) is replaced."""
    def scorer():
        odds = Odds(model.lexicon)
        return lambda texts: model.score(np.array([features(t, odds) for t in texts.to_pylist()], dtype=float).reshape(len(texts), -1)
                                         ) if len(texts) else np.empty(0)
    return score_rows(df, text_col, scorer, keep_text)
