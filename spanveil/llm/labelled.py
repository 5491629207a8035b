"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import slices
from .util import col, cut_lineage, sheltered


def crc_mod(id_: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (null for a null id)."""
    return F.pmod(F.crc32(id_.cast("string")), F.lit(m)).cast("int")


def sample_ids(labels: DataFrame, label: str, m: int, held_out: int, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` ids with their label (id, y): rows with a 0 or 1 in ``label`` whose
    crc32(id) mod ``m`` is not ``held_out``, the first in the order of a hash of the id.
    An id with several labels keeps the largest."""
    ids = labels.select(col(id_col).alias("id"), col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    ids = ids.filter(crc_mod(F.col("id"), m) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    return ids.orderBy(F.xxhash64("id"), "id").limit(limit)


def sample_rows(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", name: str = "labelled-sample") -> DataFrame:
    """One row (id, y, text) of each sampled id that ``docs`` holds, however often it repeats there: the text whose hash is least.  ``ids`` holds no more rows
    than its limit, so it is broadcast."""
    found = docs.join(F.broadcast(ids), col(id_col) == F.col("id")).groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return cut_lineage(found.select("id", "y", "t.text"), name)


def score_rows(df: DataFrame, text_col: str, scorer: Callable[[], Callable[[pa.Array], np.ndarray]], keep_text: bool = True,
               out: str = "score") -> DataFrame:
    """``df`` (without its text if not ``keep_text``) with a column ``out``; ``scorer()`` makes, once a
    task, the function from a batch of texts to scores.  An input column of that name (in any case) is replaced."""
    shelter, (text,), back = sheltered(df, text_col)
    names = [c for c in shelter.columns if keep_text or c != text]
    rows = shelter.select(*names, F.col(text).alias("text"))
    schema = shelter.select(*names).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            got = pa.array(score(batch.column(batch.num_columns - 1)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*names, "score"])
    return back(rows.mapInArrow(run, schema).withColumnRenamed("score", out), [out])
