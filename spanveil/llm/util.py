"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_tables, read_table  # noqa: F401  (re-exported)

#: word characters of the contracts: everything but space, tab, LF, VT, FF, CR
WORD = r"[^\x20\x09-\x0D]+"

#: a join side of at most this many narrow rows (ids, one or two numbers) may be broadcast
BROADCAST_ROWS = 2_000_000


def col(name: str) -> Column:
    """A top-level column whatever its name holds (dots, blanks, back-ticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def keep_columns(df: DataFrame, added: list[str]) -> list[Column]:
    """The columns of ``df`` but those whose name (in any case) an operator adds itself."""
    taken = {a.lower() for a in added}
    return [col(c) for c in df.columns if c.lower() not in taken]


def carried(names: list[str]) -> Column:
    """The named columns as one struct with fields of our own naming: it passes through any step whatever the columns are called."""
    return F.struct(F.lit(0).alias("none"), *(col(c).alias(f"c{i}") for i, c in enumerate(names)))


def restored(names: list[str], struct: str) -> list[Column]:
    """The columns carried in ``struct``, under their names again."""
    return [F.col(struct).getField(f"c{i}").alias(c) for i, c in enumerate(names)]


def sheltered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame, list[str]], DataFrame]]:
    """``df`` with its columns renamed c0, c1, ..., so that an operator's own names meet none of them; what ``names`` are called
    there; and a function (result, added) that gives the result's remaining columns their names back, followed by the added
    ones.  An input column named like an added one (in any case) gives way."""
    given = df.columns
    lower = [c.lower() for c in given]

    def back(out: DataFrame, added: list[str]) -> DataFrame:
        taken = {a.lower() for a in added}
        return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(given) if f"c{i}" in out.columns and c.lower() not in taken), *added)
    return df.toDF(*(f"c{i}" for i in range(len(given)))), [f"c{lower.index(n.lower())}" for n in names], back


def cut_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` and some aggregates of its rows (``rows``: how many), taken while it is written."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in measures.items())), name)
    return table, seen.get


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it
    is (the join then shuffles).  ``df`` should be cheap to count: a table
    already written, or a few columns of one."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def only_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is (left_semi) or is not (left_anti) in the
    one-column table ``ids``; ``ids`` is broadcast only after its rows are counted."""
    side = small(ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id IS NOT NULL").distinct(), limit)
    return df.join(side, df[key] == side["_id"], how)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
