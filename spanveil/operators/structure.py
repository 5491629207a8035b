"""Text structure and windows over text.

Nodes are the pieces a document is assembled from (paragraph runs, PDF
spans, conversation turns).  Offsets of a node are a running sum over the
nodes before it, so assembly is a window over (doc, node order) plus one
ordered string aggregate per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import spans as sp
from ..functions.batches import small


def assemble_nodes(nodes: DataFrame, sep: str = "\n") -> tuple[DataFrame, DataFrame]:
    """nodes(doc_id, node_ord, text) -> (nodes with char_start/char_end,
    documents(doc_id, text)); nodes joined with ``sep`` in order."""
    w = Window.partitionBy("doc_id").orderBy("node_ord")
    ln = F.coalesce(F.length("text"), F.lit(0))
    before = F.coalesce(F.sum(ln + len(sep)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = nodes.withColumn("char_start", before.cast("bigint")).withColumn("char_end", (before + ln).cast("bigint"))
    docs = nodes.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("node_ord", F.coalesce("text", F.lit("")).alias("t")))),
        lambda x: x["t"]), sep).alias("text"))
    return placed, docs


def span_to_node(spans: DataFrame, nodes: DataFrame, bin_width: int = 4096) -> DataFrame:
    """Every node a span overlaps, with the span's offsets inside the node.

    Binned range join on (doc_id, character bin) with the overlap as a
    residual condition: never a nested loop, and a long document compares
    only spans and nodes that share a bin.  A pair met in several bins is
    kept once (it is counted in its first common bin).
    """
    def bins(s, e):
        lo = F.floor(F.col(s) / bin_width).cast("bigint")
        hi = F.floor(F.greatest(F.col(e) - 1, F.col(s)) / bin_width).cast("bigint")
        return F.explode(F.sequence(lo, hi))

    n = nodes.select(F.col("doc_id").alias("_nd"), "node_ord", F.col("char_start").alias("ns"),
                     F.col("char_end").alias("ne"))
    n = n.withColumn("_nbin", bins("ns", "ne"))
    sp_ = spans.withColumn("_sbin", bins("char_start", "char_end"))
    first_common = F.floor(F.greatest(F.col("char_start"), F.col("ns")) / bin_width).cast("bigint")
    j = sp_.join(n, (F.col("doc_id") == F.col("_nd")) & (F.col("_sbin") == F.col("_nbin"))
                 & (F.col("ns") < F.col("char_end")) & (F.col("ne") > F.col("char_start")))
    j = j.filter(F.col("_sbin") == first_common).drop("_nd", "_sbin", "_nbin")
    return j.select("*", (F.greatest("char_start", "ns") - F.col("ns")).alias("local_start"),
                    (F.least("char_end", "ne") - F.col("ns")).alias("local_end"))


def _flat_map(src: DataFrame, width: int, make, fields: str) -> DataFrame:
    """Rows made from each row of ``src`` by ``make(values of the columns after the first ``width``)``, tuples of
    ``fields``; the first ``width`` columns are repeated.  One narrow stage."""
    schema = StructType.fromDDL(fields)
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at, rows = [], []

            def out():
                kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:width]]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
                return pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:width], *schema.names])
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[width:]), strict=True)):
                for row in make(*values):
                    at.append(i)
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield out()
                        at, rows = [], []
            yield out()
    return src.mapInArrow(run, StructType([*src.schema.fields[:width], *schema.fields]))


#: code points up to this one may be blank (Python's \s); characters of a piece of text looked at together
_LAST_BLANK, _PIECE = 0x3000, 1 << 20
_BLANKS = np.array([chr(c).isspace() for c in range(_LAST_BLANK + 1)])
_BLANK = re.compile(r"\s")
_WORD_FIELDS = "word_idx int, char_start bigint, char_end bigint, word string"
DET_FIELDS = "struct<text:string,char_start:bigint,char_end:bigint,type:string,confidence:double,reason:string>"
EXT_FIELDS = "struct<word_idx:int,explanation:string,risk_level:string,source:string>"


def _text_pieces(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (row, characters before, text) of about ``_PIECE`` characters; a longer text is cut after a blank."""
    group, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > _PIECE:
                blank = _BLANK.search(text, at + _PIECE)
                end = blank.end() if blank else end
            part = text if end - at == len(text) else text[at:end]
            if group and size + len(part) > _PIECE:
                yield group
                group, size = [], 0
            group.append((row, at, part))
            size += len(part)
            at = end
    if group:
        yield group


def _group_words(group: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The words of a group of texts: place in the group's list, start, end (characters of the whole text), and the words: their bytes are those
    of the texts without the blanks, end to end."""
    joined = "".join(t for _, _, t in group)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) for _, _, t in group])))
    word = ~_BLANKS[np.minimum(points, _LAST_BLANK)] | (points > _LAST_BLANK)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[first[:-1]] = word[first[:-1]]
    ends[first[1:] - 1] = word[first[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    upto = np.concatenate(([0], np.cumsum(np.where(word, width, 0))))
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) > len(points):
        data = data[np.repeat(word, width)]
    else:
        data = data[word]
    offsets = np.append(upto[start], upto[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    place = np.repeat(np.arange(len(group)), np.diff(np.searchsorted(start, first)))
    shift = np.array([at for _, at, _ in group], dtype=np.int64)[place] - first[place]
    return place, start + shift, end + shift, words


def _hits(place: np.ndarray, start: np.ndarray, end: np.ndarray, group: list, offsets: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """For each word the number of the first detection that overlaps it (null: none); ``offsets`` deal the detections (``low`` to
    ``high``, ascending) to the rows."""
    hit = np.full(len(start), -1, dtype=np.int64)
    bounds = np.searchsorted(place, np.arange(len(group) + 1))
    for k, (row, _, _) in enumerate(group):
        a, b = bounds[k], bounds[k + 1]
        for d in range(offsets[row], offsets[row + 1]):
            i, j = a + np.searchsorted(end[a:b], low[d], side="right"), a + np.searchsorted(start[a:b], high[d], side="left")
            if i < j:
                part = hit[i:j]
                part[part < 0] = d
    return pa.array(hit, mask=hit < 0)


def _of_words(lists: pa.ListArray, key: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words (by place in ``key``: row << 32 and number, ascending) with each element of the rows' ``lists`` that has their number
    (field word_idx, ascending in a row): a word with several stands as often, one with none once with null."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    numbers = lists.values.field("word_idx").to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
    keys = (np.repeat(np.arange(len(lists)), np.diff(offsets)) << 32) + numbers
    low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
    times = np.maximum(high - low, 1)
    word = np.repeat(np.arange(len(key)), times)
    at = offsets[0] + low[word] + np.arange(len(word)) - np.repeat(np.cumsum(times) - times, times)
    return word, pa.array(at, mask=(high == low)[word])


def _word_rows(src: DataFrame, with_dets: bool, with_ext: bool = False) -> DataFrame:
    """``src`` (doc_id, text[, detections[, external explanations]]) as rows of words, in arrays of a whole batch."""
    schema = StructType([src.schema.fields[0], *StructType.fromDDL(_WORD_FIELDS + (f", det {DET_FIELDS}" if with_dets else "")
                                                                   + (f", ext {EXT_FIELDS}" if with_ext else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if with_dets:
                lists = batch.column(2)
                offsets, dets = lists.offsets.to_numpy(), lists.values
                low, high = (dets.field(f).to_numpy(zero_copy_only=False) for f in ("char_start", "char_end"))
            last_row, count = -1, 0
            for group in _text_pieces(batch.column(1).to_pylist()):
                place, start, end, words = _group_words(group)
                bounds = np.searchsorted(place, np.arange(len(group)))
                number = np.arange(len(start)) - bounds[place]
                if group[0][0] == last_row:  # the text goes on from the piece before
                    number[place == 0] += count
                else:
                    count = 0
                sizes = np.bincount(place, minlength=len(group))
                count, last_row = (count if len(group) == 1 else 0) + int(sizes[-1]), group[-1][0]
                rows = np.array([row for row, _, _ in group])[place]
                columns = [batch.column(0).take(pa.array(rows)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(end), words]
                if with_dets:
                    columns.append(dets.take(_hits(place, start, end, group, offsets, low, high)))
                if with_ext:
                    word, at = _of_words(batch.column(3), (rows << 32) + number)
                    if len(word) > len(rows):
                        columns = [c.take(pa.array(word)) for c in columns]
                    columns.append(batch.column(3).values.take(at))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return src.mapInArrow(run, schema)


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Non-blank pieces with offsets: doc_id, word_idx, char_start, char_end, word.

    Blanks are all Unicode white space.  Offsets come with the words from one pass over the text: no word is shuffled, and
    none is a Python object.
    """
    return _word_rows(docs.select("doc_id", F.col(text_col).alias("_t")), False)


def words_with_detections(docs: DataFrame, text_col: str = "text", dets_col: str = "dets", external: DataFrame | None = None) -> DataFrame:
    """``word_table`` with ``det``, the first detection (by start) that strictly overlaps the word; the
    detections are an array of the document's row (``detect.detect_arrays``, ``gather_detections``).  With ``external`` (doc_id, word_idx,
    explanation, risk_level, source) also ``ext``, the external explanation of the word: those of a document are
    gathered and joined to its row, so texts are shuffled and no word is.  A word with several stands once for each."""
    fields = ["text", "char_start", "char_end", "type", "confidence", "reason"]
    dets = F.transform(dets_col, lambda d: F.struct(*[d[f].alias(f) for f in fields]))
    src = docs.select("doc_id", F.col(text_col).alias("_t"), F.array_sort(dets, lambda a, b: F.when(a["char_start"] < b["char_start"], -1).when(
        a["char_start"] > b["char_start"], 1).otherwise(0)).alias("_d"))
    if external is None:
        return _word_rows(src, True)
    said = external.filter("word_idx BETWEEN 0 AND 2147483647").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("word_idx").cast("int").alias("word_idx"), "explanation", "risk_level", "source"))).alias("_e"))
    return _word_rows(src.join(said, "doc_id", "left").select("doc_id", "_t", "_d", "_e"), True, True)


def gather_detections(docs: DataFrame, dets: DataFrame) -> DataFrame:
    """``docs`` with the array ``dets`` of each document's rows in ``dets`` (reviewed ones, say): spans are shuffled
    by document, and joined to the text."""
    fields = ["text", "char_start", "char_end", "type", "confidence", "reason"]
    rows = dets.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("dets"))
    return docs.join(rows, "doc_id", "left")


def _segments(text: str | None, dets: list[dict] | None) -> Iterator[tuple]:
    text, at, n = text or "", 0, 0
    for d in sorted(dets or [], key=lambda d: d["s"]):
        for kind, s, e, key in (("plain", at, d["s"], None), ("detection", d["s"], d["e"], d["id"])):
            if e > s:
                yield n, kind, s, e, key, text[s:e]
                n += 1
        at = max(at, d["e"])
    if len(text) > at:
        yield n, "plain", at, len(text), None, text[at:]


def segments(docs: DataFrame, dets: DataFrame, text_col: str = "text") -> DataFrame:
    """Alternating plain and detection segments in start order (spans must
    not overlap).  Every document yields at least its plain text; the
    concatenation of a document's segments equals the document."""
    arr = dets.groupBy("doc_id").agg(F.collect_list(F.struct(
        F.col("char_start").alias("s"), F.col("char_end").alias("e"), F.col("det_id").alias("id"))).alias("_d"))
    j = docs.select("doc_id", F.col(text_col).alias("_t")).join(arr, "doc_id", "left").select("doc_id", "_t", "_d")
    return _flat_map(j, 1, _segments, "seg_idx int, kind string, char_start bigint, char_end bigint, det_id string, text string")


def first_occurrence(text: Column, selection: Column) -> Column:
    """0-based index of the first literal occurrence, -1 when absent."""
    return F.instr(text, selection) - 1


def _found(query: str | None, text: str | None, whole_words: bool) -> Iterator[tuple]:
    if query and text:
        pattern = re.escape(query)
        if whole_words:
            pattern = rf"(?<!\S){pattern}(?!\S)"
        for i, m in enumerate(re.finditer(pattern, text, re.IGNORECASE)):
            yield i, m.start(), m.end(), m.group()


def search_highlight(docs: DataFrame, queries: DataFrame, text_col: str = "text", whole_words: bool = False) -> DataFrame:
    """All occurrences of each document's query string, ignoring case, with offsets; with ``whole_words``
    only words equal to it.  ``queries``: doc_id, query."""
    j = docs.select("doc_id", F.col(text_col).alias("_t")).join(queries, "doc_id").select("doc_id", "query", F.col("query").alias("_q"), "_t")
    return _flat_map(j, 2, lambda q, t: _found(q, t, whole_words), "match_idx int, char_start bigint, char_end bigint, match string")


def context_window(docs: DataFrame, spans: DataFrame, radius: int = 200, limit: int | None = None,
                   text_col: str = "text") -> DataFrame:
    """Text from start-radius to end+radius, clipped to the document;
    ``limit`` clips the context (prompt use: 1500)."""
    j = spans.join(docs.select("doc_id", F.col(text_col).alias("_t")), "doc_id")
    lo = F.greatest(F.col("char_start") - radius, F.lit(0))
    hi = F.least(F.col("char_end") + radius, F.length("_t"))
    ctx = sp.cut(F.col("_t"), lo.cast("int"), hi.cast("int"))
    if limit is not None:
        ctx = F.substring(ctx, 1, limit)
    return (j.withColumn("ctx_start", lo.cast("bigint")).withColumn("ctx_end", hi.cast("bigint"))
            .withColumn("context", ctx).drop("_t"))
