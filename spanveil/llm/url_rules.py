"""URL allow and block rules by a sort-merge range join.

A host is written with its labels reversed, each closed by a dot
(``www.example.com`` -> ``com.example.www.``).  A rule's host then covers exactly
the keys that start with its own key: an interval of the sorted keys, and two
such intervals are nested or disjoint.  URLs and rules are sorted by key
together; one sweep over a partition keeps the rules whose interval holds the
current key on a stack, and picks the longest whose path starts the URL's path.

URLs are cut into ranges of (key, path, row), so one host of any size spreads over
many partitions; each rule goes to the ranges that its interval meets.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import col, cut_lineage, keep_columns, sheltered

DEFAULT_VERDICT = "allow"

ADDED = ["host", "path", "rule", "verdict"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each with a closing dot; empty for an empty host."""
    labels = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.when(F.length(host) > 0, F.concat(labels, F.lit("."))).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


class Sweep:
    """The stack of one pass over sorted keys.  Levels are hosts; a level knows its
    rules by path, and the path lengths that occur, longest first."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple], list[int]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: tuple) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, level, lengths = self.stack[-1]
        if -len(path) not in lengths:
            insort(lengths, -len(path))
        # of equal rules the blocking one stands
        if path not in level or rule[1] == "block":
            level[path] = rule

    def best(self, key: str, path: str) -> tuple:
        """(rule, verdict) of the longest rule (characters of host and path; then the longer host)."""
        self.move(key)
        found, length = (None, None), -1
        for _, level, lengths in reversed(self.stack):
            for n in lengths:
                rule = level.get(path[:-n]) if len(path) >= -n and n else level.get("") if not n else None
                if rule is not None:
                    if len(rule[0]) > length:
                        found, length = rule, len(rule[0])
                    break
        return found


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition sorted by (_part, _key, _kind): rules (0) come before the URLs (1) of a key."""
    part, sweep = None, Sweep()
    for rows in batches:
        out = []
        for p, key, kind, path, name, verdict, row in zip(rows["_part"], rows["_key"], rows["_kind"], rows["_path"],
                                                          rows["_rule"], rows["_verdict"], rows["_row"], strict=True):
            if p != part:
                part, sweep = p, Sweep()
            if kind == 0:
                sweep.open(key, path, (name, verdict))
            else:
                out.append((row, *sweep.best(key, path)))
        yield pd.DataFrame(out, columns=["_row", "rule", "verdict"])


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``df`` with host, path, rule (host + path of the rule that decides, else null)
    and verdict ('allow' or 'block'; ``default`` where no rule fits).

    A rule (verdict, host, path) fits its host and all subdomains if the URL's path
    starts with the rule's; a rule with an empty host fits every host.  The longest
    fitting rule decides (characters of host and path, then of the host); of equal
    rules the blocking one.  Null URLs and those without ``://`` have empty host and
    path and, like any other, are judged by rules of an empty host only.  Rows may
    repeat.  Input columns named like a result column (in any case) are replaced.
    Columns besides the URL take no part in the sweep and are joined to its result.
    """
    shelter, (url,), back = sheltered(df, url_col)
    return back(_judge_urls(shelter, rules, url, default), ADDED)


def _judge_urls(df: DataFrame, rules: DataFrame, url_col: str, default: str) -> DataFrame:
    """``judge_urls`` of a table whose columns are called c0, c1, ..."""
    url = col(url_col)
    keyed = df.select(*keep_columns(df, ADDED), url_host(url).alias("host"), url_path(url).alias("path"))
    keyed = keyed.withColumns({"_key": host_key(F.col("host")), "_row": F.monotonically_increasing_id()})
    # written once: rules are dealt to the ranges as they came out
    placed = cut_lineage(keyed.repartitionByRange("_key", "path", "_row").withColumn("_part", F.spark_partition_id()), "urls")

    # one row per range partition
    bounds = placed.groupBy("_part").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    clean = rules.select(
        F.col("verdict").alias("_verdict"), host_key(F.col("host")).alias("_rkey"), F.col("path").alias("_path"),
        F.concat("host", "path").alias("_rule"))
    # keys that start with _rkey lie from _rkey up to the same with its last dot (0x2E) raised to a slash (0x2F)
    end = F.when(F.col("_rkey") != "", F.concat(F.expr("substring(_rkey, 1, length(_rkey) - 1)"), F.lit("/")))
    dealt = clean.withColumn("_rend", end).join(
        F.broadcast(bounds), (F.col("_rkey") <= F.col("_hi")) & (F.col("_rend").isNull() | (F.col("_rend") > F.col("_lo"))))
    events = dealt.select("_part", F.col("_rkey").alias("_key"), F.lit(0).alias("_kind"), "_path", "_rule", "_verdict",
                          F.lit(-1).cast("long").alias("_row"))
    points = placed.select("_part", "_key", F.lit(1).alias("_kind"), F.col("path").alias("_path"),
                           F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_verdict"), "_row")
    swept = events.unionByName(points).repartition("_part").sortWithinPartitions("_part", "_key", "_kind", "_path").mapInPandas(
        _sweep, "_row long, rule string, verdict string")
    out = placed.join(swept.withColumnsRenamed({"rule": "_found", "verdict": "_said"}), "_row")
    return out.select(*keep_columns(df, ADDED), "host", "path", F.col("_found").alias("rule"),
                      F.coalesce("_said", F.lit(default)).alias("verdict"))
