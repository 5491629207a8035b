"""The optional model-scoring hook.

A zero-shot entity model scores chunks of text; its output is the
``raw_entities`` table that the policy filter (C6) consumes.
Scoring runs in Arrow batches over chunk rows: Spark partitions the chunks
(long documents become many rows, spread over the cluster) and the scorer is loaded once per
task.  No weights ship with this engine, so the default scorer is the
reproducible pattern stand-in; a real model plugs in through
``scorer_factory``: a callable without arguments that returns
``score(text, labels, threshold, doc_id, start_offset) -> iterable of (label, start, end, score)``,
positions relative to the chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as tb
from .chunk import to_document_offsets

Scorer = Callable[[str, list | None, float | None, int, int], Iterable[tuple[str, int, int, float]]]

_RAW = pa.schema([("doc_id", pa.int64()), ("start_offset", pa.int64()), ("label", pa.string()), ("text", pa.string()),
                  ("char_start", pa.int64()), ("char_end", pa.int64()), ("score", pa.float64())])
_RAW_SQL = "doc_id bigint, start_offset bigint, label string, text string, char_start bigint, char_end bigint, score double"


def standin_scorer() -> Scorer:
    """Pattern stand-in with the model's interface; its score depends on the document and the place in it."""
    compiled = [(label, re.compile(rx)) for label, rx in tb.STANDIN_ENTITY_PATTERNS]

    def score(text, labels, threshold, doc_id, start_offset):
        for label, rx in compiled:
            if labels is not None and label not in labels:
                continue
            for m in rx.finditer(text):
                value = round(0.40 + (doc_id * 37 + start_offset + m.start()) % 60 / 100, 2)
                if threshold is None or value >= threshold:
                    yield label, m.start(), m.end(), value
    return score


def score_chunks(chunks: DataFrame, scorer_factory: Callable[[], Scorer] = standin_scorer) -> DataFrame:
    """raw_entities (doc_id, label, text, char_start, char_end, score) of all chunks, in document offsets, each once.

    ``chunks`` comes from ``chunk.chunk_documents``; its columns ``labels`` (array) and ``threshold``, if
    there, are what each document's policy asks the model for (``detect.resolve_policies``).
    """
    pick = lambda c, t: F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c)
    src = chunks.select("doc_id", "start_offset", "text", pick("labels", "array<string>"), pick("threshold", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer_factory()
        for batch in batches:
            rows = []
            for doc, offset, text, labels, threshold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for label, s, e, value in score(text or "", labels, threshold, doc, offset):
                    rows.append((doc, offset, label, text[s:e], s, e, float(value)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _RAW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RAW, strict=True)], schema=_RAW)
    return to_document_offsets(src.mapInArrow(run, _RAW_SQL)).drop("start_offset").distinct()
