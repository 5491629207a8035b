"""Packing of tokenized documents into sequences by minimum bin slack.

Only the lengths matter for the plan, and a length is at most the capacity: the pieces are counted by length, and
the plan is made on those counts (``capacity`` numbers, whatever the size of the table).  For each sequence, the longest
length left is set and subset-sum dynamic programming over bitsets finds the fullest combination with the others;
a combination is removed as often as the counts allow, which is what taking it again and again would come to.
Pieces are then numbered within their length (shares of a length are numbered apart and shifted by prefix sums),
and a piece finds its sequence and place in the plan by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import slices
from .token_ids import worker_encoder
from .util import carried, col, cut_lineage, restored

CAPACITY = 2048
#: pieces numbered by one task
SHARE_ROWS = 200_000


def fullest(counts: dict[int, int], room: int, longest_first: list[int]) -> dict[int, int]:
    """The combination of the available lengths with the largest sum up to ``room``; among those, the one with more of the
    longer lengths is taken.  Subset sums are bits of an integer, one state per step of the lengths."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    full = 1 << room
    for length in longest_first:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often}) until no piece is left; every combination holds the longest length left."""
    counts = {k: v for k, v in counts.items() if v}
    lengths, out = sorted(counts, reverse=True), []
    while counts:
        lengths = [n for n in lengths if n in counts]
        longest = lengths[0]
        counts[longest] -= 1
        chosen = fullest(counts, capacity - longest, lengths)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((times, chosen))
    return out


def _places(made: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by length and number of the piece within its length."""
    rows, used, sequence = [], {}, 0
    for times, chosen in made:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, used.get(n, 0), chosen[n], sequence, offset))
            used[n] = used.get(n, 0) + chosen[n] * times
            offset += n * chosen[n]
        sequence += times
    rows.sort()
    names = ("length", "base", "uses", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def token_pieces(docs: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """The columns of ``docs`` but the text (input columns named like an added one, in any case, go), then piece, start, length,
    ids_crc32 and, if asked, ids: a document is its ids and ``end_id``; only one longer than ``capacity`` is cut."""
    added = {"piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", text_col.lower()}
    names = [c for c in docs.columns if c.lower() not in added]
    source = docs.select(carried(names).alias("kept"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    fields = [source.schema["kept"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = worker_encoder(shared.value), np.array([end_id], dtype=np.uint32)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows, numbers, starts, parts = [], [], [], []
            for row, ids in enumerate(encoder.ids(batch.column(1))):
                ids = np.concatenate((ids, last))
                for number, at in enumerate(range(0, len(ids), capacity)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at)
                    parts.append(ids[at:at + capacity])
            columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                       pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
            if keep_ids:
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
    return source.mapInArrow(run, T.StructType(fields)).select(*restored(names, "kept"), *(f.name for f in fields[1:]))


def pack(docs: DataFrame, path: str, text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True,
         share_rows: int = SHARE_ROWS) -> DataFrame:
    """The columns of ``docs`` but the text, then piece (int, from 0), start, length, ids_crc32 (unsigned), ids (if ``keep_ids``), sequence_id
    and offset: every document by the tokenizer at ``path`` in as few sequences of ``capacity`` ids as minimum bin slack
    finds; sequences are numbered from 0 and filled without gaps.

    A null text is empty: one piece of just ``end_id``.  Repeated rows are packed each for itself; which of several pieces of one
    length gets which place is arbitrary, but fixed once written.  Null ids and other columns pass through, but input
    columns named like an added one (in any case) give way.  An empty table gives no rows."""
    pieces = cut_lineage(token_pieces(docs, path, text_col, capacity, end_id, keep_ids).withColumn("sequence_id", F.monotonically_increasing_id()), "packing-pieces")  # the number of a row, once written, stays
    by_length = pieces.groupBy("length").agg(F.count("*").alias("c")).collect()  # at most ``capacity`` rows
    total = sum(r["c"] for r in by_length)
    places = _places(plan({r["length"]: r["c"] for r in by_length}, capacity))
    shares = max(1, -(-total // share_rows))
    names = pieces.columns[:-1]
    numbered = pieces.select(carried(names).alias("kept"), F.col("length").alias("n"), F.col("sequence_id").alias("uid"),
                             F.pmod(F.xxhash64("sequence_id"), F.lit(shares)).cast("int").alias("share"))
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("n", "share").orderBy("uid")) - 1)
    before = pieces.groupBy(F.col("length").alias("n"), F.pmod(F.xxhash64("sequence_id"), F.lit(shares)).cast("int").alias("share")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("n").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("n", "share", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"))
    numbered = numbered.join(before, ["n", "share"]).select("kept", "n", (F.col("number") + F.col("before")).cast("long").alias("number"))
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        # one key for (length, number): numbers stay below 2**48
        keys = (p["length"] << 48) + p["base"]
        for batch in batches:
            n, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = np.searchsorted(keys, (n << 48) + number, side="right") - 1
            copy, k = np.divmod(number - p["base"][at], p["uses"][at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p["sequence"][at] + copy), pa.array(p["offset"][at] + k * n)],
                                             names=["kept", "sequence_id", "offset"])
    schema = T.StructType([numbered.schema["kept"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = numbered.mapInArrow(place, schema)
    return placed.select(*restored(names, "kept"), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves, from pieces with their ids.  A group is one sequence, never
    more than its capacity of ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("flatten(transform(p, x -> x.ids))").alias("ids")).select("sequence_id", F.size("ids").alias("length"), "ids")
