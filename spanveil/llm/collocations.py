"""Phrase collocation mining with Rabin-Karp fingerprints.

Words and n-grams are hashed by prefix polynomials over whole batches.  Pass by pass (one word, two
words, ...) the fingerprints are counted: tasks aggregate them, the shuffle adds the counts.  An n-gram can only
be frequent if its first and last n-1 words are, so a pass sends only n-grams whose two parts stand in
a bit table of the frequent fingerprints before; that table has at most 2**``TABLE_BITS`` bits (16 MB), and a
false hit in it costs a shuffled row, never a result.  The last pass goes over the text once more: occurrences of
fingerprints that proved frequent are compared word by word with the occurrence their pointer names, and
only those phrases are made into strings and counted by their text, so colliding fingerprints part
there.  All counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import LOWER, Piece, byte_class, pieces, run_hashes
from .shingles import mix64, slices
from .util import col, cut_lineage, default_parallelism

LONGEST, LEAST, FIRST = 5, 100, 2000
#: bits of a table of frequent fingerprints, at most
TABLE_BITS = 27
#: fingerprints, and phrases, that a task gathers before it passes them on
GATHER = 1 << 21
GATHER_PHRASES = 300_000

_BREAKS = byte_class(".,;:!?\n\x0b\x0c\r")
_INSIDE = ~(_BREAKS | byte_class(" \t"))


def _seeds(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = langs.dictionary_encode()
    known = [sum((b + 1) * pow(0x100000001B3, i + 1, 1 << 64) for i, b in enumerate(s.encode("utf-8", "surrogatepass"))) % (1 << 64) for s in coded.dictionary.to_pylist()]
    return mix64(np.array(known, dtype=np.uint64))[coded.indices.to_numpy(zero_copy_only=False)] if known else np.empty(0, np.uint64)


def _fingerprints(piece: Piece, seeds: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Fingerprints of the n-grams at each word (those over a separator too; the caller drops them)."""
    runs = run_hashes(piece.hashed, n)
    return mix64(runs ^ seeds[piece.row[:len(runs)]]) & np.uint64((1 << bits) - 1)


def _inside_parts(piece: Piece, n: int) -> np.ndarray:
    """Which n-grams have no separator inside and a last word that is new in the piece."""
    many = len(piece.part) - n + 1
    if many <= 0:
        return np.empty(0, bool)
    ok = piece.part[:many] == piece.part[n - 1:]
    ok[:max(0, piece.fresh - n + 1)] = False
    return ok


def _hits(table: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    at = _slot(fingerprints, len(table) * 8)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _slot(fingerprints: np.ndarray, size: int) -> np.ndarray:
    return mix64(fingerprints) & np.uint64(size - 1)


def _survivors(piece: Piece, seeds: np.ndarray, n: int, tables: list[np.ndarray], bits: int) -> np.ndarray:
    """Places of the n-grams whose parts, n-1 words each, are in the table of the pass before."""
    ok = _inside_parts(piece, n)
    if n > 1 and len(ok):
        known = _hits(tables[n - 2], _fingerprints(piece, seeds, n - 1, bits))
        ok &= known[:len(ok)] & known[1:len(ok) + 1]
    return np.flatnonzero(ok)


class _Sums:
    """Counts of fingerprints, passed on when many."""

    def __init__(self):
        self.keys, self.counts, self.held, self.dense = [], [], 0, 0

    def add(self, fingerprints: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(fingerprints, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > max(GATHER, 2 * self.dense):
            self._compact()
            if self.dense > GATHER:
                yield from self.rest()

    def _compact(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first)]
        self.held = self.dense = len(first)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._compact()
            for a in range(0, self.held, 1 << 16):
                b = a + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(self.keys[0][a:b].view(np.int64)), pa.array(self.counts[0][a:b].astype(np.int64))], names=["fp", "c"])
            self.__init__()


def _count_pass(n: int, tables, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = _Sums(), tables.value if tables is not None else []
        for batch in (part for whole in batches for part in slices(whole, 1)):
            seeds = _seeds(batch.column(0))
            for piece in pieces(batch.column(1), _INSIDE, _BREAKS, LOWER, LONGEST - 1):
                at = _survivors(piece, seeds, n, held, bits)
                if len(at):
                    yield from sums.add(_fingerprints(piece, seeds, n, bits)[at])
        yield from sums.rest()
    return run


def _word_ids(piece: Piece) -> np.ndarray:
    """A number for each word, equal where the bytes are; hashes of words are checked against the bytes."""
    _, first, ids = np.unique(piece.hashed, return_index=True, return_inverse=True)
    size = piece.end - piece.start
    same = np.array_equal(size, size[first][ids])
    if same and len(size):
        at = np.repeat(piece.start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        like = np.repeat(piece.start[first][ids] - piece.start, size) + at
        same = np.array_equal(piece.data[at], piece.data[like])
    if same:
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(piece.data[a:b].tobytes(), len(known)) for a, b in zip(piece.start, piece.end, strict=True)], dtype=np.int64)


def _groups(fingerprints: np.ndarray, at: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pointers (a place each) to the different n-grams among the places ``at``, and how often each occurs.  Occurrences of one
    fingerprint are compared word by word with the first of them; where they differ, the words themselves are grouped."""
    _, first, of, counts = np.unique(fingerprints, return_index=True, return_inverse=True, return_counts=True)
    if all(np.array_equal(ids[at + k], ids[at[first] + k][of]) for k in range(n)):
        return at[first], counts
    runs = np.stack([ids[at + k] for k in range(n)], axis=1)
    _, first, counts = np.unique(runs, axis=0, return_index=True, return_counts=True)
    return at[first], counts


def _phrase_pass(tables, bits: int):
    """Rows (lang, n, phrase, c) of the n-grams whose fingerprints are frequent, and (lang, 0, null, words of the language)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered, words = tables.value, {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(lang, phrase.count(b" ") + 1, phrase, c) for (lang, phrase), c in gathered.items()]
            rows += [(lang, 0, None, c) for lang, c in words.items()]
            gathered.clear()
            words.clear()
            for a in range(0, len(rows), 1 << 15):
                langs, ns, phrases, counts = zip(*rows[a:a + (1 << 15)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ns, pa.int32()),
                                                  pa.array(phrases, pa.binary()).view(pa.string()), pa.array(counts, pa.int64())], names=["lang", "n", "phrase", "c"])
        for batch in (part for whole in batches for part in slices(whole, 1)):
            seeds, coded = _seeds(batch.column(0)), batch.column(0).dictionary_encode()
            names, of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(1), _INSIDE, _BREAKS, LOWER, LONGEST - 1):
                if not len(piece.start):
                    continue
                for code, c in enumerate(np.bincount(of_row[piece.row[piece.fresh:]], minlength=len(names)).tolist()):
                    if c:
                        words[names[code]] = words.get(names[code], 0) + c
                ids = _word_ids(piece)
                code = of_row[piece.row]
                for n in range(1, LONGEST + 1):
                    at = _survivors(piece, seeds, n, held, bits)
                    found = _fingerprints(piece, seeds, n, bits)[at] if len(at) else np.empty(0, np.uint64)
                    hit = _hits(held[n - 1], found)
                    at, found = at[hit], found[hit]
                    if not len(at):
                        break
                    # the language is part of what is compared
                    point, counts = _groups(found, at, ids * len(names) + code, n)
                    a, b = piece.start[point], piece.end[point + n - 1]
                    size = sum((piece.end - piece.start)[point + k] for k in range(n))
                    plain = b - a == size + n - 1
                    for k in range(n - 1):
                        plain &= piece.data[np.minimum(piece.end[point + k], len(piece.data) - 1)] == 0x20
                    for i, p, q, is_plain, c, lang in zip(point.tolist(), a.tolist(), b.tolist(), plain.tolist(), counts.tolist(), code[point].tolist(), strict=True):
                        phrase = piece.data[p:q].tobytes() if is_plain else b" ".join(
                            piece.data[s:e].tobytes() for s, e in zip(piece.start[i:i + n], piece.end[i:i + n], strict=True))
                        key = (names[lang], phrase)
                        gathered[key] = gathered.get(key, 0) + c
                    if len(gathered) > GATHER_PHRASES:
                        yield from out()
        yield from out()
    return run


def _bit_table(frequent: DataFrame) -> np.ndarray:
    """The frequent fingerprints as a bit table of about 16 bits for each, 2**``TABLE_BITS`` at most."""
    many = frequent.count()
    size = 1 << min(TABLE_BITS, max(16, int(many).bit_length() + 4))

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slot(batch.column(0).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])
    words = frequent.select("fp").mapInArrow(slot, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size >> 6, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table.view(np.uint8)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f): every phrase of 1 to ``LONGEST`` words with ``least`` occurrences or more in its
    language, exactly counted; and (lang, total): all word occurrences of a language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    tables: list[np.ndarray] = []
    shared = None
    for n in range(1, LONGEST + 1):
        counted = texts.mapInArrow(_count_pass(n, shared, bits), "fp long, c long")
        frequent = counted.repartition(F.col("fp")).groupBy("fp").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("fp")
        tables.append(_bit_table(cut_lineage(frequent, f"frequent-{n}")))
        if shared is not None:
            shared.unpersist()
        shared = spark.sparkContext.broadcast(tables)
    found = cut_lineage(texts.mapInArrow(_phrase_pass(shared, bits), "lang string, n int, phrase string, c long")
                        .groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f")).filter((F.col("f") >= least) | (F.col("n") == 0)), "phrases")
    return found.filter("n > 0"), found.filter("n = 0").select("lang", F.col("f").alias("total"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST,
                 salts: int | None = None, bits: int = 64) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score, cut (words of the first part): each language's ``first`` collocations.

    Texts are lower-cased (A-Z only) and split at ``.,;:!?`` and line ends; phrases have 2 to ``LONGEST`` words and ``least``
    occurrences (overlapping ones count).  A cut after k words gives l and r, the occurrences of both sides,
    and the score floor(1000*a*n/(l*r)), n being all words of the language; the least cut counts, ties to the smaller k.  A phrase that a
    longer one always contains (same count) is dropped.  Order: score, occurrences, phrase (UTF-8 bytes).

    Null texts are empty; a null language is ``und`` and shares it with rows of that very name.  Repeated rows count each time.
    Ties are broken as above, so the result is unique.  An empty table, or one without frequent phrases, gives no rows.  Other
    columns are ignored.  ``bits`` narrows the fingerprints (for tests of collisions)."""
    counts, totals = phrase_counts(docs, text_col, lang_col, least, bits)
    salts = salts or default_parallelism(docs.sparkSession)
    phrases = counts.filter("n > 1")
    # a longer phrase with the same count exists exactly if one of one word more does
    longer = phrases.filter("n > 2").select("lang", F.col("f"), F.explode(F.array(
        F.expr("substring_index(phrase, ' ', n - 1)"), F.expr("substring_index(phrase, ' ', 1 - n)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter("within IS NULL OR 100 * within < 100 * f").drop("within")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, n - 1)"))).withColumn("p", F.expr("substring_index(phrase, ' ', cut)")) \
        .withColumn("q", F.expr("substring_index(phrase, ' ', cut - n)"))
    side = lambda p, f: counts.select("lang", F.col("phrase").alias(p), F.col("f").alias(f))
    cuts = cuts.join(side("p", "l"), ["lang", "p"]).join(side("q", "r"), ["lang", "q"])
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cuts = cuts.withColumn("salt", salt).join(totals, ["lang", "salt"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_over", (wide("f") * wide("total")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("_under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("lang", "phrase", "salt").agg(F.min(F.struct("score", "cut", "l", "r", "f", "total")).alias("b")).select("lang", "phrase", "salt", "b.*")
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    # first within a share of the language's phrases, then over the shares
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("total").alias("n"), "score", F.col("cut").cast("long").alias("cut"))
