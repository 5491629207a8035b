"""Contiguous shards of near equal bytes by global prefix sums.

The rows are put into one global order (hash of the text, then id), cut into
range partitions.  Each partition reports its total of bytes and rows; a prefix
sum over these totals (one row per partition) gives every partition its global
offset, and a running sum inside each partition gives every row its position.
The shards are that global order cut at equal byte targets.

Equal texts are neighbours in the order, so copies share a shard unless a cut
falls between them; a group of copies of any size is split by the range
partitioner on (hash, id, row) and by the cuts, never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import col, cut_lineage, keep_columns, sheltered

#: bytes that a row takes besides its text
ROW_BYTES = 16

ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_by_bytes(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   row_bytes: int = ROW_BYTES, keep_text: bool = True) -> DataFrame:
    """``df`` with size (UTF-8 bytes of the text plus ``row_bytes``), text_crc32,
    law ('bytes'), shard (0 to n_shards-1), slot (gapless from 0 within a shard,
    in the global order) and grown_shard (null: adding a shard moves the cuts).

    A row lies in the shard in which its middle byte falls, so each shard's bytes
    are within one row's size of the target.  Null texts count as empty.  Rows that
    agree in text and id are ordered by their place in the input.  An empty table
    gives an empty result.  Input columns named like a result column (in any
    case) are replaced.  ``keep_text=False`` leaves the text out, so that only
    narrow rows are shuffled.
    """
    shelter, names, back = sheltered(df, id_col, text_col)
    return back(_shard_by_bytes(shelter, n_shards, *names, row_bytes, keep_text), ADDED)


def _shard_by_bytes(df: DataFrame, n_shards: int, id_col: str, text_col: str, row_bytes: int, keep_text: bool) -> DataFrame:
    """``shard_by_bytes`` of a table whose columns are called c0, c1, ..."""
    kept = df.columns if keep_text else [c for c in df.columns if c.lower() != text_col.lower()]
    text = F.coalesce(col(text_col), F.lit(""))
    keyed = df.select(
        *keep_columns(df.select(*map(col, kept)), ADDED),
        (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_sh_hash"),
        col(id_col).alias("_sh_id"),
        F.monotonically_increasing_id().alias("_sh_row"))
    order = ["_sh_hash", "_sh_id", "_sh_row"]
    # written once: the partition of a row must be the same for the totals and the running sums
    placed = cut_lineage(keyed.repartitionByRange(*order).withColumn("_sh_part", F.spark_partition_id()), "shard-order")

    upto = Window.orderBy("_sh_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = placed.groupBy("_sh_part").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    offsets = totals.select(
        "_sh_part",
        F.coalesce(F.sum("_b").over(upto), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_rows_before"),
        F.sum("_b").over(everything).alias("_total"))
    inside = Window.partitionBy("_sh_part").orderBy(*order)
    running = placed.withColumns({
        "_upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_nth": F.row_number().over(inside)})
    # one row per range partition: bounded by the number of shuffle partitions
    placed_at = running.join(F.broadcast(offsets), "_sh_part")
    shard = (f"int(least({n_shards - 1}L, (2 * (_before + _upto) - size) div "
             f"greatest(1L, (2 * _total + {n_shards - 1}) div {n_shards})))")
    cut = placed_at.withColumns({"shard": F.expr(shard), "_index": F.expr("_rows_before + _nth - 1")})
    # at most n_shards rows
    first = cut.groupBy("shard").agg(F.min("_index").alias("_first"))
    out = cut.join(F.broadcast(first), "shard")
    return out.select(*keep_columns(df.select(*map(col, kept)), ADDED), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("_index") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
