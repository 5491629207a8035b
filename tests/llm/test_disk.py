"""What the joins leave on disk: shuffle files of written tables, working tables, rows dealt to pairs of chunks."""

import os
import time
from glob import glob

from pyspark.sql import functions as F

from spanveil.llm import components, jaccard_join
from spanveil.session import SHUFFLE_CLEANUP, cut_lineage, drop_tables, ensure_checkpoint_dir

from . import brute


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob(f"{d}/*/shuffle_*.data")}


def tables(spark):
    return {os.path.basename(p) for p in glob(os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "tables", "*"))}


def corpus():
    base = [[f"b{g}x{i}" for i in range(60)] for g in range(3)]
    return [(k, " ".join(base[k % 3][:60 - k % 5] + [f"end{k % 7}"])) for k in range(60)]


def test_shuffle_files_go_when_the_table_is_written(spark):
    held = spark.conf.get(SHUFFLE_CLEANUP)
    df = spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).count()
    before = shuffle_files(spark)
    table = cut_lineage(df, "test-shuffle")
    for _ in range(50):  # the files are removed a little later
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == held
    assert table.count() == df.count() == 500  # the plan that was written runs again


def test_only_tables_that_were_written_are_dropped(spark):
    kept, gone = cut_lineage(spark.range(5), "test-kept"), cut_lineage(spark.range(5), "test-gone")
    drop_tables(gone, gone, kept.select("id"), spark.range(3))
    left = {t[:-33] for t in tables(spark)}
    assert "test-kept" in left and "test-gone" not in left and kept.count() == 5


def test_components_keep_their_last_round_only(spark):
    before = tables(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    got = components.components(edges, "test-components")
    assert len(tables(spark) - before) == 1
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(41)}


def test_join_drops_its_working_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    for limits in ({}, {"rare": 2, "small_bucket": 2}):
        before = tables(spark)
        got = jaccard_join.jaccard_components(docs, **limits)
        left = {t[:-33] for t in tables(spark) - before}
        assert left <= {"jaccard-sketch", "jaccard-first", "jaccard-components", "families"}
        assert sorted(map(tuple, got.collect()), key=repr) == brute.jaccard_components(corpus())
        before = tables(spark)
        jaccard_join.one_of_each(docs, **limits)
        assert "jaccard-sketch" not in {t[:-33] for t in tables(spark) - before}


def test_small_sets_are_sent_to_few_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    members = spark.range(32).selectExpr("0L AS root", "id AS node", "100 AS n", "CASE WHEN id < 16 THEN 0L ELSE id END AS comp")
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 3200)  # the family is one chunk
    assert jaccard_join._chunk_rows(members).count() == 16 + 32
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 1600)  # two chunks against one
    rows = jaccard_join._chunk_rows(members)
    assert rows.count() == 2 * 16 + 32 and rows.select("i", "j").distinct().count() == 2
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 1)  # no smaller chunks than of CHUNK nodes
    rows = jaccard_join._chunk_rows(members)
    assert rows.count() == 8 * 16 + 4 * 32
    both = rows.filter("side = 0").select("root", "i", "j", F.col("node").alias("a")).join(
        rows.filter("side = 1").select("root", "i", "j", F.col("node").alias("b")), ["root", "i", "j"])
    assert both.count() == both.select("a", "b").distinct().count() == 16 * 32


def test_links_of_large_buckets_in_many_chunks(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tokens in (1, 300, 1 << 18):
        monkeypatch.setattr(jaccard_join, "CHUNK", 3)
        monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", tokens)
        got = jaccard_join.jaccard_components(docs, words=5, percent=80, rare=2, small_bucket=2)
        assert sorted(map(tuple, got.collect()), key=repr) == brute.jaccard_components(rows, 5, 80)
