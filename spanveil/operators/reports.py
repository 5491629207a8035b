"""Reviewer reports (G1-G11): hash aggregations with map-side partial
aggregation, so only one small row per group and partition is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as tb
from ..session import cut_lineage

def _redacted() -> Column:
    return F.col("status").isin("redacted", "added")


def status_counts(dets: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """G1+G2 per document: missed, redacted (incl. added), false_positive,
    dismissed, total, reviewed = total - missed - fp, progress percent
    (100 when a document has no detections).  With ``docs`` every document
    appears, also those without detections."""
    c = dets.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "missed").alias("missed"),
        F.count_if(_redacted()).alias("redacted"),
        F.count_if(F.col("status") == "false_positive").alias("false_positive"),
        F.count_if(F.col("status") == "dismissed").alias("dismissed"),
        F.count(F.lit(1)).alias("total"))
    if docs is not None:
        c = docs.select("doc_id").join(c, "doc_id", "left").na.fill(
            0, ["missed", "redacted", "false_positive", "dismissed", "total"])
    return c.select("*", (F.col("total") - F.col("missed") - F.col("false_positive")).alias("reviewed"),
                    progress_percent(F.col("total"), F.col("missed")).alias("progress"))


def progress_percent(total: Column, missed: Column) -> Column:
    """round((total - missed) / total * 100), half up; 100 when total is 0."""
    return F.when(total > 0, F.round((total - missed) / total * 100, 0).cast("bigint")).otherwise(F.lit(100).cast("bigint"))


def type_stats(dets: DataFrame) -> DataFrame:
    """G3 per type: total, redacted (incl. added), missed."""
    return dets.groupBy("type").agg(F.count(F.lit(1)).alias("total"), F.count_if(_redacted()).alias("redacted"),
                                    F.count_if(F.col("status") == "missed").alias("missed"))


def type_rollup(dets: DataFrame) -> DataFrame:
    """G3 extra: rollup(source, type) with grouping level."""
    return dets.rollup("source", "type").agg(F.count(F.lit(1)).alias("total"), F.count_if(_redacted()).alias("redacted"),
                                             F.grouping_id().alias("level"))


def safety_score(counts: DataFrame) -> DataFrame:
    """A+ when nothing is missed (or nothing detected); otherwise the
    addressed share (redacted + dismissed) graded A >= 90, B >= 70, else C."""
    pct = F.round((F.col("redacted") + F.col("dismissed")) / F.col("total") * 100, 0).cast("bigint")
    clear = (F.col("total") == 0) | (F.col("missed") == 0)
    grade = F.when(clear, F.lit(tb.SAFETY_CLEARED[0]))
    label = F.when(clear, F.lit(tb.SAFETY_CLEARED[1]))
    for lo, g, lab in tb.SAFETY_GRADES:
        grade = grade.when(pct >= lo, F.lit(g))
        label = label.when(pct >= lo, F.lit(lab))
    score = F.when(clear, F.lit(tb.SAFETY_CLEARED[2]).cast("bigint")).otherwise(pct)
    return counts.select("doc_id", grade.alias("grade"), label.alias("label"), score.alias("score"))


def export_gate(counts: DataFrame) -> DataFrame:
    """Documents that may be exported (nothing missed)."""
    return counts.filter(F.col("missed") == 0).select("doc_id")


def file_badges(counts: DataFrame) -> DataFrame:
    """G6: 'N pending' when something is missed, else 'Ready'."""
    return counts.select("doc_id", F.when(F.col("missed") > 0, F.concat(F.col("missed").cast("string"), F.lit(" pending")))
                         .otherwise(F.lit("Ready")).alias("badge"))


def source_label(source: Column) -> Column:
    """Dual, heuristic, manual, anything else is the model."""
    return F.when(source.isin("dual", "heuristic", "manual"), source).otherwise(F.lit("model"))


def sanitization_audit(dets: DataFrame, meta_audit: DataFrame | None = None) -> DataFrame:
    """Three sections per document: stripped metadata (not links),
    detached links (link audits + URL and EMAIL_ADDRESS detections),
    secured tokens (text, type) of every confirmed detection."""
    conf = dets.filter(_redacted())
    parts = tb.DETACHED_DETECTION.split("{v}")
    links = conf.filter(F.col("type").isin("URL", "EMAIL_ADDRESS")).select(
        "doc_id", F.lit("links").alias("section"), F.concat(F.lit(parts[0]), F.col("text"), F.lit(parts[1])).alias("item"),
        F.col("type"))
    tokens = conf.select("doc_id", F.lit("tokens").alias("section"), F.col("text").alias("item"), "type")
    out = links.unionByName(tokens)
    if meta_audit is not None:
        m = meta_audit.select("doc_id", F.explode("audit").alias("item"))
        is_link = F.col("item").contains("Hyperlink") | F.col("item").contains("Interactive Link")
        out = out.unionByName(m.select("doc_id", F.when(is_link, F.lit("links")).otherwise(F.lit("metadata")).alias("section"),
                                       "item", F.lit(None).cast("string").alias("type")))
    return out


#: values sorted at the end of a selection, at most
SELECT_ROWS = 20_000


def kth_smallest(df: DataFrame, column: str, k: int) -> float:
    """The value of rank ``k`` (from 0) of a double column (nulls do not count), exactly and without sorting it: two pivots near the rank come from a quantile
    sketch of bounded size, the values below, between and above them are counted, and the part that holds the rank is looked at alone, until few are left."""
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    if not 0 <= k < n:
        raise ValueError(f"rank {k} of {n} values")
    while n > SELECT_ROWS:
        p = (k + 0.5) / n
        low, high = rows.agg(F.percentile_approx("v", [max(0.0, p - 5e-4), min(1.0, p + 5e-4)], 10_000)).first()[0]
        cuts = [F.col("v") < low, F.col("v") == low, (F.col("v") > low) & (F.col("v") < high), (F.col("v") == high) & (F.col("v") > low)]
        counts = rows.agg(*(F.count_if(c) for c in cuts)).first()
        part = 0
        while part < 4 and k >= counts[part]:
            k -= counts[part]
            part += 1
        if part in (1, 3):
            return low if part == 1 else high
        rows = rows.filter(cuts[part] if part < 4 else F.col("v") > high)
        n = counts[part] if part < 4 else n - sum(counts)
    return sorted(r.v for r in rows.collect())[k]


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median as ``percentile(column, 0.5)`` gives it, without all values in one task."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        return None
    low = kth_smallest(df, column, (n - 1) // 2)
    return low if n % 2 else (low + kth_smallest(df, column, n // 2)) / 2


def latency_stats(progress: DataFrame) -> DataFrame:
    """G9 over per-document completion latencies (seconds since batch start):
    total time (= max latency), time to first file, files per second,
    min, max, mean, median (exact, by selection: ``exact_median``)."""
    progress = cut_lineage(progress, "latencies")  # looked at several times
    lat = F.col("latency_s")
    return progress.agg(
        F.count(F.lit(1)).alias("n_files"), F.max(lat).alias("total_time_s"), F.min(lat).alias("time_to_first_s"),
        (F.count(F.lit(1)) / F.max(lat)).alias("files_per_s"), F.min(lat).alias("min_s"), F.max(lat).alias("max_s"),
        F.avg(lat).alias("mean_s"), F.lit(exact_median(progress, "latency_s")).cast("double").alias("median_s"))
