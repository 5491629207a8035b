"""Matching in very long documents over many tasks.

A long text is cut into pieces that are matched apart.  Leftmost non-overlapping matching runs from left to right, so what is
found in a piece depends on where the last match before it ends.  That end is the piece's entry: nearly always the cut itself.  Each
piece is matched from its cut and from every other entry that a match across the cut could give (the chains soon meet); a fold
over the small table of entries and exits then tells which chain of each piece holds.  The result is that of a single pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import docspans as ds
from ..functions import spans as sp
from ..functions import tables as tb
from ..session import cut_lineage
from .detect import _pattern_rows, pattern_spans

#: characters of a piece; shorter texts are matched where they lie
PIECE_CHARS = 1 << 20
#: a pattern whose matches may be longer counts as unbounded
_WIDEST = 4096


def _asserted(node) -> Iterator[tuple[int, int]]:
    """(direction, width) of every look-ahead and look-behind of a parsed pattern."""
    if isinstance(node, re._parser.SubPattern):
        for op, arg in node.data:
            if str(op) in ("ASSERT", "ASSERT_NOT"):
                yield arg[0], arg[1].getwidth()[1]
            yield from _asserted(arg)
    elif isinstance(node, (tuple, list)):
        for x in node:
            yield from _asserted(x)


def extent(pattern: str) -> tuple[int | None, int]:
    """(longest match or None, widest look to one side) in characters; raises ValueError where a look has no bound."""
    tree = re._parser.parse(pattern)
    look = 2 + sum(width for _, width in _asserted(tree))
    if look > _WIDEST:
        raise ValueError(f"a look-ahead without bound: {pattern}")
    widest = tree.getwidth()[1]
    return (widest if widest <= _WIDEST else None), look


def splits(pattern: str) -> bool:
    """Matches of the pattern can be found in pieces: they are bounded, or lie within runs without blanks."""
    try:
        return extent(pattern)[0] is not None or ds.blank_free(pattern)
    except ValueError:
        return False


class _Cutter:
    """Windows of pieces: as far as a match that touches the piece can reach, and what it looks at."""

    def __init__(self, regexes: Sequence[str]):
        known = [extent(p) for p in regexes]
        self.width = max([w for w, _ in known if w is not None], default=0)
        self.look = max(look for _, look in known)
        self.endless = [sp.required_literals(p) for p, (w, _) in zip(regexes, known, strict=True) if w is None]
        self.run = (0, 0, False)

    def _run(self, text: str, at: int) -> tuple[int, int]:
        """The blank-free run around ``at`` if an unbounded pattern may match in it, else the place itself."""
        a, b, holds = self.run
        if not a < at < b:
            end = ds._BLANK.search(text, at)
            a, b, step = at, end.start() if end else len(text), 256
            while a > 0:
                low = max(0, a - step)
                blanks = [m.end() for m in ds._BLANK.finditer(text, low, a)]
                a, step = (blanks[-1] if blanks else low), step * 2
                if blanks:
                    break
            holds = any(all(text.find(x, a, b) >= 0 for x in literals) for literals in self.endless)
            self.run = (a, b, holds)
        return (a, b) if holds else (at, at)

    def windows(self, text: str, size: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(piece, start, end, window start, window end)."""
        self.run = (0, 0, False)
        low = 0
        for k, start in enumerate(range(0, len(text), size)):
            end = min(start + size, len(text))
            a, b = self._run(text, end) if end < len(text) else (end, end)
            yield k, start, end, low, min(len(text), max(end + self.width, b) + self.look)
            low = max(0, min(end - self.width, a) - self.look)


def _chains(matcher: tuple, text: str, start: int, end: int, width: int | None):
    """The chains of one pattern over a piece [start, end) of the window ``text``: a list of (entry, own matches, (chain, from) that
    it runs into or None, exit), that of the cut first."""
    pattern, literals, runs_only = matcher
    owner: dict[int, int] = {}
    chains = []

    def add(entry: int) -> None:
        own, into, exit_ = [], None, max(entry, end)
        for m in ds.Matcher._matches(pattern, literals, runs_only, text, entry) if entry < end else ():
            s, e = m.span()
            if s >= end:
                break
            if s in owner:
                into = (owner[s], s)
                break
            own.append((s, e, m.group()))
            exit_ = max(exit_, e)
        c = len(chains)
        owner.update((s, c) for s, _, _ in own)
        chains.append((entry, own, into, chains[into[0]][3] if into else exit_))
    if not literals or all(x in text for x in literals):
        add(start)
        low = 0
        if width is not None:
            low = max(0, start - width)
        else:
            blanks = [m.end() for m in ds._BLANK.finditer(text, 0, start)]
            low = blanks[-1] if blanks else 0
            ahead = ds._BLANK.search(text, start)
            if not all(text.find(x, low, ahead.start() if ahead else len(text)) >= 0 for x in literals):
                low = start
        ends = {m.end() for s in range(low, start) if (m := pattern.match(text, s))}
        for entry in sorted(x for x in ends if x > start):
            add(entry)
    else:
        chains.append((start, [], None, end))
    return chains


_FOUND = ("doc_id {id}, piece int, pat_idx int, chain int, entry bigint, leave bigint, "
          "parts array<struct<chain:int,low:bigint>>, char_start bigint, char_end bigint, text string, kept boolean, sure boolean")


def _follow(chains: list, c: int, base: int) -> list[dict]:
    out, low = [], chains[c][0]
    while True:
        out.append({"chain": c, "low": base + low})
        if chains[c][2] is None:
            return out
        c, low = chains[c][2]


def _match_pieces(regexes: Sequence[str], schema: pa.Schema):
    rows = [(r, sp.required_literals(r)) for r in regexes]
    widths = [extent(r)[0] for r in regexes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = ds.Matcher(rows).patterns
        for batch in batches:
            ids, *columns = (c.to_pylist() for c in batch.columns)
            out = []
            for doc, piece, start, end, base, text in zip(ids, *columns, strict=True):
                for p, matcher in enumerate(compiled):
                    chains = _chains(matcher, text, start - base, end - base, widths[p])
                    sure = len(chains) == 1
                    for c, (entry, own, _, leave) in enumerate(chains):
                        out.append((doc, piece, p, c, base + entry, base + leave, _follow(chains, c, base), None, None, None, None, sure))
                        out.extend((doc, piece, p, c, None, None, None, base + s, base + e, m, len(m.strip()) >= tb.HEURISTIC_MIN_TRIMMED_LENGTH, sure)
                                   for s, e, m in own)
            made = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
    return run


def _cut_texts(regexes: Sequence[str], size: int):
    names = ["doc_id", "piece", "start", "end", "base", "text"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(regexes)
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for k, start, end, low, high in cutter.windows(text, size):
                    # one piece a batch: no task holds the pieces of a text beside the text
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), *(pa.array([v], t) for v, t in zip((k, start, end, low, text[low:high]), types, strict=True))], names=names)
    return run


def _held(rows: pd.DataFrame) -> pd.DataFrame:
    """The chain that holds in each piece of one document and pattern: entries follow from the exits before."""
    out, leave = [], 0
    rows = rows.sort_values(["piece", "entry"])
    for piece, ways in rows.groupby("piece", sort=True):
        entry = max(leave, int(ways["entry"].iloc[0]))
        way = ways[ways["entry"] == entry].iloc[0]
        leave = int(way["leave"])
        if not way["sure"]:
            out.extend((way["doc_id"], way["pat_idx"], piece, part["chain"], part["low"]) for part in way["parts"])
    return pd.DataFrame(out, columns=["doc_id", "pat_idx", "piece", "chain", "low"]).astype({"pat_idx": "int32", "piece": "int32", "chain": "int32", "low": "int64"})


def _same(left: str, right: str, names: Sequence[str]):
    return F.expr(" AND ".join(f"{left}.{n} <=> {right}.{n}" for n in names))


def split_spans(docs: DataFrame, patterns: Sequence = tb.HEURISTIC_PATTERNS, text_col: str = "text", id_col: str = "doc_id",
                piece_chars: int = PIECE_CHARS) -> DataFrame:
    """All matches of every pattern, as ``detect.pattern_spans``, with the texts of more than ``piece_chars`` characters spread over
    the cluster in pieces.  ``id_col`` names a text: no two long texts share one (null counts as a name).

    Patterns that are neither bounded (4,096 characters) nor free of blanks are looked for in the whole text, in one task a
    document.  A window reaches beyond its piece by the longest bounded match, and to the ends of a blank-free run that holds the literals of an unbounded pattern.
    """
    rows = _pattern_rows(patterns)
    dealt = [i for i, r in enumerate(rows) if splits(r[1])]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > piece_chars
    short = pattern_spans(base.filter(~long), patterns)
    whole = [i for i in range(len(rows)) if i not in dealt]
    if whole:
        number = F.element_at(F.array(*map(F.lit, whole)), F.col("pat_idx") + 1)
        short = short.unionByName(pattern_spans(base.filter(long), [rows[i] for i in whole]).withColumn("pat_idx", number))
    if not dealt:
        return short

    regexes = [rows[i][1] for i in dealt]
    kind = base.schema["doc_id"].dataType
    piece_schema = f"doc_id {kind.simpleString()}, piece int, start bigint, end bigint, base bigint, text string"
    pieces = base.filter(long).mapInArrow(_cut_texts(regexes, piece_chars), piece_schema).repartition("doc_id", "piece")
    found_schema = StructType.fromDDL(_FOUND.format(id=kind.simpleString()))
    found = cut_lineage(pieces.mapInArrow(_match_pieces(regexes, to_arrow_schema(found_schema)), found_schema), "split-spans")

    ways = found.filter("entry IS NOT NULL").select("doc_id", "pat_idx", "piece", "entry", "leave", "parts", "sure")
    held = ways.groupBy("doc_id", "pat_idx").applyInPandas(
        _held, f"doc_id {kind.simpleString()}, pat_idx int, piece int, chain int, low bigint")
    hits = found.filter("char_start IS NOT NULL").select("doc_id", "pat_idx", "piece", "chain", "char_start", "char_end", "text", "kept", "sure")
    chosen = hits.filter("NOT sure").alias("h").join(
        held.alias("w"), _same("h", "w", ("doc_id", "pat_idx", "piece", "chain")) & F.expr("h.char_start >= w.low"), "left_semi")
    hits = hits.filter("sure").unionByName(chosen)

    # numbers: matches of the pieces before, and the place in the piece
    key = ("doc_id", "pat_idx", "piece")
    before = Window.partitionBy("doc_id", "pat_idx").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("char_start")))
    numbered = placed.alias("h").join(counts.alias("c"), _same("h", "c", key)).select("h.*", (F.col("before") + F.col("place") - 1).alias("match_idx"))

    def of(column: int, cast: str):
        return F.element_at(F.array(*[F.lit(rows[i][column]).cast(cast) for i in dealt]), F.col("pat_idx") + 1)
    out = numbered.filter("kept").select(
        "doc_id", F.element_at(F.array(*map(F.lit, dealt)), F.col("pat_idx") + 1).alias("pat_idx"), F.col("match_idx").cast("int").alias("match_idx"),
        "char_start", "char_end", "text", of(2, "string").alias("type"), of(3, "double").alias("base_conf"), of(4, "string").alias("base_reason"))
    return short.unionByName(out)
