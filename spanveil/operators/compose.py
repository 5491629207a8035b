"""Ordered folds of long groups as a tree.

Where the steps of a fold are associative summaries, a group need not lie in one array: runs of 2**``BITS`` places are
merged in parallel, then runs of those, until one is left.  No task holds more than one such run,
however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: places merged by one step are 2**BITS
BITS = 8


def fold_tree(rows: DataFrame, keys: list[str], merge: str, zero: str, emitted: str | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame | None]:
    """``rows``: ``keys``, place (bigint, the order), e (a struct: the summary of one step).

    ``merge`` is the SQL of a summary of ``_a`` followed by ``_x``, ``zero`` that of no step.  Gives (keys, e), one row a
    key; and, if ``emitted`` names an array field of the summaries, (keys, value) of all that any merge put there (the field
    is emptied from level to level).  Places need not be dense; rows of one place are merged in the order of their summaries."""
    span = rows.agg(F.min("place").alias("lo"), F.max("place").alias("hi")).first()
    low, reach = span["lo"] or 0, (span["hi"] or 0) - (span["lo"] or 0)
    level = rows.select(*keys, (F.col("place") - F.lit(low).cast("bigint")).alias("place"), "e")
    found = None
    for _ in range(max(1, -(-reach.bit_length() // bits))):
        runs = level.groupBy(*keys, F.shiftright("place", bits).alias("place")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), "e"))).alias("run"))
        level = runs.select(*keys, "place", F.expr(f"aggregate(transform(run, r -> r.e), {zero}, (_a, _x) -> {merge})").alias("e"))
        if emitted:
            here = level.select(*keys, F.explode(f"e.{emitted}").alias("value"))
            found = here if found is None else found.unionByName(here)
            level = level.withColumn("e", F.col("e").withField(emitted, F.expr(f"slice(e.{emitted}, 1, 0)")))
    return level.select(*keys, "e"), found
