"""Overlapping chunking of long documents.

The cut positions of one document depend on each other (each start is the
previous end minus the overlap), so a document is cut in one pass over its
text, map side and without a shuffle.  Chunks are rows: a long document turns into many that later
stages can spread over the cluster (``repartition`` by chunk).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import tables as tb
from ..functions.batches import small
from .detect import merge_overlaps

#: chunks put into one output batch
_BATCH = 2000


def chunk_bounds(text: str | None, max_chars: int = tb.CHUNK_MAX_CHARS, overlap: int = tb.CHUNK_OVERLAP,
                 nl_window: int = tb.CHUNK_NEWLINE_WINDOW, sp_window: int = tb.CHUNK_SPACE_WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text.

    Length <= max_chars: one chunk (also for empty text).  Otherwise cut at
    start+max_chars, moved back to the last newline when it lies less than
    ``nl_window`` before the cut, else to the last space when less than
    ``sp_window`` before; next start = end - overlap; stop at the end.  Only the window before a cut is searched.
    """
    n = len(text or "")
    if n <= max_chars:
        return [(0, n)]
    out, start = [], 0
    while True:
        end = min(start + max_chars, n)
        if end < n:
            for blank, window in (("\n", nl_window), (" ", sp_window)):
                at = text.rfind(blank, max(start, end - window + 1), end)
                if at >= 0:
                    end = at
                    break
        out.append((start, end))
        if end >= n:
            return out
        start = max(end - overlap, 0)


def chunk_documents(docs: DataFrame, text_col: str = "text", keep_text: bool = True, keep: Sequence[str] = (), **kw) -> DataFrame:
    """chunks(doc_id, *keep, chunk_idx, start_offset, end_offset, n_chunks[, text])."""
    src = docs.select("doc_id", *keep, F.col(text_col).alias("_text"))
    n = 1 + len(keep)
    fields = [("chunk_idx", pa.int32()), ("start_offset", pa.int64()), ("end_offset", pa.int64()), ("n_chunks", pa.int32())]
    ddl = "chunk_idx int, start_offset bigint, end_offset bigint, n_chunks int"
    if keep_text:
        fields.append(("text", pa.string()))
        ddl += ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at, rows):
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:n]]
            made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)]
            return pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:n], *(f for f, _ in fields)])
        for batch in small(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column(n).to_pylist()):
                bounds = chunk_bounds(text, **kw)
                for k, (s, e) in enumerate(bounds):
                    at.append(i)
                    rows.append((k, s, e, len(bounds), *([(text or "")[s:e]] if keep_text else [])))
                    if len(rows) == _BATCH:
                        yield out(at, rows)
                        at, rows = [], []
            yield out(at, rows)
    return src.mapInArrow(run, StructType([*src.schema.fields[:-1], *StructType.fromDDL(ddl).fields]))


def to_document_offsets(spans: DataFrame) -> DataFrame:
    """B2: chunk-relative spans to document offsets (add start_offset)."""
    return (spans.withColumn("char_start", F.col("char_start") + F.col("start_offset"))
            .withColumn("char_end", F.col("char_end") + F.col("start_offset")))


def union_across_chunks(entities: DataFrame) -> DataFrame:
    """Entities found in the overlap of two chunks, whole or as fragments, become one (C14): nothing is
    dropped at a cut.  ``entities``: doc_id, label, text, char_start, char_end (document offsets), score."""
    spans = entities.distinct().select("doc_id", "char_start", "char_end", "text", F.col("label").alias("type"),
                                       F.col("score").alias("confidence"), F.col("char_end").alias("_o1"), F.col("label").alias("_o2"))
    return merge_overlaps(spans, ("_o1", "_o2")).select(
        "doc_id", F.col("type").alias("label"), "char_start", "char_end", "text", F.col("confidence").alias("score"))
