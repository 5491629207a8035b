"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u)/w, u uniform from a hash of its
id, w its quality weight; ascending keys are a weighted sample without
replacement of every length at once.  A source whose target is e whole times
its size plus a rest takes every document e times, and the documents first in
key order up to the rest once more.

A source is never sorted as a whole: keys fall into ``BLOCKS`` blocks by a
monotone map to (0, 1); block totals tell in which block the rest ends, and only
that block is sorted for the exact cut.  The cut, one row per source, is then
applied to the documents where they lie: their text is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, col, cut_lineage, keep_columns, sheltered, small

#: source weights in code-point order of the source, repeating
WEIGHTS = (5, 2, 1)
#: a source is taken at most so many times over
MAX_EPOCHS = 3
#: key blocks a source is cut into
BLOCKS = 1024

ADDED = ["size", "source_size", "target", "taken", "copies"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of letters and blanks in the text (1 for an empty one)."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.when(F.length(text) > 0, F.lit(0.05) + F.lit(0.95) * share), F.lit(1.0))


def sampling_key(id_: Column, weight: Column, seed: str) -> Column:
    """-ln(u)/w with u in (0, 1) from 52 bits of the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.ln((number + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with target (double).

    Targets share the sum of all sizes by weight; one above ``max_epochs`` times
    its source's size is cut to that and the excess goes to the others by weight
    until none is above.  The fixed point is a common level: target =
    min(max_epochs * size, level * weight), found by one prefix sum over the sources
    in the order in which they reach their limit.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", rank.alias("_rank"), weight.cast("long").alias("_w"))
    filling = Window.orderBy(F.expr(f"{max_epochs} * source_size / double(_w)"), "_rank")
    level = ranked.withColumns({
        "_all": F.sum("source_size").over(everything),
        "_capped": F.coalesce(F.sum(F.expr(f"{max_epochs} * source_size")).over(
            filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("_w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    level = level.withColumn("_level", F.expr("double(_all - _capped) / double(_open)"))
    # the first source that its own level does not lift above its limit
    level = level.withColumn("_level", F.min_by(
        "_level", F.expr(f"CASE WHEN _level * _w <= {max_epochs} * source_size "
                         f"THEN struct({max_epochs} * source_size / double(_w), _rank) END")).over(everything))
    return level.select("source", "source_size",
                        F.least(F.expr(f"double({max_epochs} * source_size)"), F.expr("_level * _w")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1", blocks: int = BLOCKS) -> DataFrame:
    """``df`` with size (words of the text), source_size, target (of its source),
    copies (times the mix takes the document) and taken (copies * size).

    A document is taken in the last, partial epoch if at least half of it lies
    before the target, so a source misses its target by half a document at most.
    Null texts have size 0; sources may be null (one source of their own, last in
    order); a source of empty texts only is taken once.  Rows that agree in id,
    source and size share a key and are taken alike.  Input columns named like a
    result column (in any case) are replaced.  Same input, same result.
    """
    shelter, names, back = sheltered(df, id_col, source_col, text_col)
    return back(_mix(shelter, *names, weights, max_epochs, seed, blocks), ADDED)


def _mix(df: DataFrame, id_col: str, source_col: str, text_col: str, weights, max_epochs: int, seed: str, blocks: int) -> DataFrame:
    """``mix`` of a table whose columns are called c0, c1, ..."""
    text = col(text_col)
    keyed = df.withColumns({
        "_mx_size": word_count(text),
        "_mx_key": sampling_key(col(id_col), quality_weight(text), seed),
        "_mx_source": col(source_col), "_mx_id": F.coalesce(col(id_col).cast("string"), F.lit(""))})
    narrow = cut_lineage(keyed.select(
        F.col("_mx_source").alias("source"), F.col("_mx_id").alias("id"), F.col("_mx_size").alias("size"),
        F.col("_mx_key").alias("key"),
        F.least(F.lit(blocks - 1), F.floor((1 - F.exp(-F.col("_mx_key"))) * blocks)).cast("int").alias("block")),
        "mix-keys")

    block = cut_lineage(narrow.groupBy("source", "block").agg(F.sum("size").alias("n")), "mix-blocks")
    sizes = block.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, max_epochs).withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    }).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    # the block of each source in which the rest ends, and the words before it
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = block.withColumn("hi", F.sum("n").over(upto)).alias("b").join(
        small(targets).alias("t"), F.expr("b.source <=> t.source")).filter("hi > rest").groupBy("t.source").agg(
        F.min(F.struct("block", (F.col("hi") - F.col("n")).alias("lo"))).alias("last"))
    reach = cut_lineage(reach.select("source", "last.block", "last.lo"), "mix-cut-blocks")
    # rows of these blocks only, exactly ordered
    order = Window.partitionBy("source").orderBy("key", "id", "size")
    inside = narrow.alias("n").join(small(reach).alias("r"), F.expr("n.source <=> r.source AND n.block = r.block")).select(
        "n.source", "key", "id", "size", "lo").withColumn(
        "before", F.col("lo") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    chosen = inside.alias("i").join(small(targets).alias("t"), F.expr("i.source <=> t.source")).filter(
        "2 * before + size <= 2 * rest").groupBy("t.source").agg(F.max(F.struct("key", "id", "size")).alias("upto"))
    cuts = targets.alias("t").join(reach.alias("r"), F.expr("t.source <=> r.source"), "left").join(
        chosen.alias("c"), F.expr("t.source <=> c.source"), "left").select(
        F.col("t.source").alias("_ct_source"), "source_size", "target", F.col("epochs").alias("_epochs"),
        F.col("r.block").alias("_cut_block"), F.col("c.upto").alias("_upto"))
    cuts = cut_lineage(cuts, "mix-cuts")

    base = keyed.select(*keep_columns(df, ADDED), "_mx_source", "_mx_id", "_mx_size", "_mx_key")
    at = F.least(F.lit(blocks - 1), F.floor((1 - F.exp(-F.col("_mx_key"))) * blocks)).cast("int")
    in_rest = (F.col("_cut_block").isNull() | (at < F.col("_cut_block")) | F.coalesce(
        (at == F.col("_cut_block")) & (F.struct(F.col("_mx_key").alias("key"), F.col("_mx_id").alias("id"),
                                                F.col("_mx_size").alias("size")) <= F.col("_upto")), F.lit(False)))
    out = base.join(small(cuts), F.expr("_mx_source <=> _ct_source"))
    copies = F.col("_epochs") + in_rest.cast("long")
    return out.select(*keep_columns(df, ADDED), F.col("_mx_size").alias("size"), "source_size", "target",
                      (copies * F.col("_mx_size")).alias("taken"), copies.alias("copies"))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a mixed table as often as the mix takes it."""
    return mixed.filter("copies > 0").select(
        *[col(c) for c in columns], F.explode(F.expr("sequence(1L, copies)")).alias("_epoch")).drop("_epoch")


def repeated(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each row of ``df``, its columns unchanged whatever they are called, as often as the mix takes it."""
    shelter, names, back = sheltered(df, id_col, source_col, text_col)
    mixed = _mix(shelter, *names, WEIGHTS, MAX_EPOCHS, "mix-1", BLOCKS).filter("copies > 0")
    return back(mixed.withColumn("epoch", F.explode(F.expr("sequence(1L, copies)"))), [])
