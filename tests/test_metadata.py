"""Metadata of pages."""

from pyspark.sql import functions as F

from spanveil.operators import redact as rd


def test_extract_metadata(spark):
    pages = [
        (1, """<html><head><TITLE lang=en> A title </TITLE><meta name="author" content="Ann O'Neil"><META content='Tool 1 > 0' NAME='Generator'>
            <meta property=article:published_time content=2024-01-02><meta name="last-modified" content="2024-02-03"><meta name="creator" content="Press"></head>"""),
        (2, """<meta charset="utf-8"><meta name="author" content=" "><meta name="dc.creator" content="B"><meta name="og:title" content="T"><p data-name="author" content="no">"""),
        (3, ""), (4, None), (5, "<title>x" * 1000 + "<meta " * 1000)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: tuple(r.m) for r in df.select("page_id", rd.extract_metadata(F.col("html")).alias("m")).collect()}
    assert got == {1: ("Ann O'Neil", "Press", "A title", "2024-01-02", "2024-02-03", "Tool 1 > 0"), 2: ("B", "", "T", "", "", ""),
                   3: ("",) * 6, 4: ("",) * 6, 5: ("",) * 6}
    audit = df.filter("page_id = 1").select(rd.metadata_audit(rd.metadata_map(rd.extract_metadata(F.col("html"))), F.lit("pdf")).alias("a")).first().a
    assert len(audit) == 6 and audit[0].startswith("Author Tag: 'Ann O'Neil'")
