"""Connected components of an edge table by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, under the
smallest node of its neighbourhood (Kiveris et al.); the number of rounds grows
with the logarithm of the component size.  All state is an edge table written once
a round to the shared checkpoint folder, in place of the one before; nothing is collected but its number of rows and a checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut_lineage, cut_measured, drop_tables


def _each_of(*rows: str) -> Column:
    """``rows`` ("u, v" expressions) as rows of their own: a table given twice over is read once, and its plan is half as long."""
    return F.explode(F.array(*(F.expr(f"struct({r})") for r in rows))).alias("e")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(_each_of("u, v", "v AS u, u AS v")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(_each_of("v AS u, m AS v", "u, m AS v")).select("e.u", "e.v")
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (u, v) undirected, any order, repeats and self-loops allowed; gives
    (node, root) for every node that has an edge to another, the root being the
    smallest node of the component."""
    # written first: a round names its edges several times, and with them the whole plan of what they come from
    state, seen = cut_lineage(edges.filter("u <> v").select("u", "v").distinct(), name), None
    while True:
        before = state
        state, now = cut_measured(_small_star(_large_star(before)), name, check=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        drop_tables(before)
        if now == seen or not now["rows"]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
