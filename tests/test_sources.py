"""Binary file source, UTF-8 decode, CSV flattening."""

import os
import tempfile

from spanveil.sources import io


def test_read_files_decode_and_filter(spark):
    root = tempfile.mkdtemp(prefix="spanveil-src-")
    os.makedirs(os.path.join(root, "sub", "deeper"))
    with open(os.path.join(root, "a.txt"), "wb") as f:
        f.write("café ok".encode() + b"\xff\xfe" + b" end")
    with open(os.path.join(root, "sub", "B.CSV"), "wb") as f:
        f.write(b'name, note\n Ann , "x, y"\n ,\n')
    with open(os.path.join(root, "sub", "deeper", "c.pdf"), "wb") as f:
        f.write(b"%PDF-1.4 raw")
    with open(os.path.join(root, "skip.bin"), "wb") as f:
        f.write(b"zzz")
    rows = {r.filename: r for r in io.read_files(spark, root).collect()}
    assert set(rows) == {"a.txt", "B.CSV", "c.pdf"}
    assert rows["a.txt"].text == "café ok end"                   # invalid bytes dropped
    assert rows["B.CSV"].file_type == "csv" and rows["c.pdf"].file_type == "pdf"
    assert bytes(rows["c.pdf"].content) == b"%PDF-1.4 raw"            # raw bytes kept
    assert rows["c.pdf"].parsed is False
    flat = io.flatten_csv(spark.createDataFrame([(rows["B.CSV"].text,)], "f string"), "f")
    import csv
    expected = "\n".join(" | ".join(c.strip() for c in row if c.strip())
                         for row in csv.reader(rows["B.CSV"].text.splitlines()))
    # Python's csv reader sees no quoting after a leading blank
    assert flat.first().f == expected
    texts = ['a,"x, ""y""",b', 'a,"x\ny",b', 'q,"' + "z" * 300_000 + '"', "", None]
    quoted = [r.f for r in io.flatten_csv(spark.createDataFrame([(t,) for t in texts], "f string"), "f").collect()]
    assert quoted[:2] == ['a | x, "y" | b', "a | xy | b"] and len(quoted[2]) == 300_004 and quoted[3:] == ["", None]


def test_latest_per_key(spark):
    old = spark.createDataFrame([("a", "missed"), ("b", "missed")], "det_id string, status string")
    new = spark.createDataFrame([("a", "redacted"), ("c", "added")], "det_id string, status string")
    got = {r.det_id: r.status for r in io.latest_per_key(old, new, key="det_id").collect()}
    assert got == {"a": "redacted", "b": "missed", "c": "added"}
    # by document: what the newer snapshot of a document deleted does not come back
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "doc_id long, det_id string")
    new = spark.createDataFrame([(1, "a"), (1, "c")], "doc_id long, det_id string")
    assert sorted(map(tuple, io.latest_per_key(old, new, key="doc_id").collect())) == [(1, "a"), (1, "c"), (2, "x")]


def test_named_files_come_back_by_name(spark, tmp_path):
    from spanveil.sources import named_files as nf
    rows = [(f"doc_{i}.txt", f"text é {i}\n" * 3, None) for i in range(50)] + [("bad/name.txt", "x", None), ("none.txt", None, None), ("", "x", None), ("left.txt", "x", "error")]
    files = spark.createDataFrame(rows, "out_name string, text string, error string").repartition(3)
    nf.write_files(files, str(tmp_path / "out"))
    got = {r.out_name: r.text for r in nf.read_back(spark, str(tmp_path / "out")).collect()}
    assert got == {n: t for n, t, e in rows[:50]}
    errors = [line for d in os.listdir(tmp_path / "out") if os.path.exists(tmp_path / "out" / d / nf.ERRORS) for line in open(tmp_path / "out" / d / nf.ERRORS)]
    assert len(errors) == 3 and not os.path.exists(tmp_path / "out" / nf.STAGING)
    # an empty export leaves nothing
    nf.write_files(files.limit(0), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or os.listdir(tmp_path / "none") == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F
    from spanveil.sources import named_files as nf
    fails = F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.lit("text"))
    files = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("out_name"), fails.alias("text"), F.lit(None).cast("string").alias("error"))
    with pytest.raises(Exception, match="broken row"):
        nf.write_files(files, str(tmp_path / "out"))
    # tasks that were still running may have left something in the staging folder, nowhere else
    assert not os.path.exists(tmp_path / "out") or set(os.listdir(tmp_path / "out")) <= {nf.STAGING}
    assert nf.read_back(spark, str(tmp_path)).count() == 0


def test_the_driver_lists_no_files_of_an_export(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from spanveil.sources import named_files as nf
    rows = spark.range(0, 600, 1, 3).select(F.format_string("a b%% %d.txt", "id").alias("out_name"), F.repeat(F.lit("text "), 500).alias("text"), F.lit(None).cast("string").alias("error"))
    nf.write_files(rows, str(tmp_path))
    listed, listing = [], nf._listed
    monkeypatch.setattr(nf, "_listed", lambda store, folder: listed.append(folder) or listing(store, folder))
    back = nf.read_back(spark, str(tmp_path) + "/")
    assert {r.out_name: r.text for r in back.collect()} == {f"a b% {i}.txt": "text " * 500 for i in range(600)}
    # the driver looked at the folders of the three tasks, their files are listed by three tasks
    assert listed == [str(tmp_path)] and back.inputFiles() == [] and back.rdd.getNumPartitions() == 3
    # of unknown size, so that a join does not broadcast the texts
    assert back._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40
    monkeypatch.undo()
    # files in the folder itself and below folders of folders, hidden ones passed over
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for at in ("own.txt", "_own.txt", "deep/er/low.txt", "deep/.low.txt"):
        (tmp_path / at).write_bytes(b"caf\xc3\xa9 \xff" * 3)
    got = {r.out_name: r.text for r in nf.read_back(spark, str(tmp_path)).collect()}
    assert len(got) == 602 and got["own.txt"] == got["low.txt"] == "café " * 3
    assert sum(b.num_rows for b in nf._contents(str(tmp_path), str(tmp_path), True)) == 602
    assert max(b.nbytes for b in nf._contents(str(tmp_path), str(tmp_path), True)) < 2 * nf.MOST_BYTES


def test_exact_median_by_selection(spark, monkeypatch):
    import random
    from pyspark.sql import functions as F
    from spanveil.operators import reports as rp
    monkeypatch.setattr(rp, "SELECT_ROWS", 5)
    r = random.Random(2)
    cases = [[1.5], [1.0, 2.0], [3.0] * 40, [r.random() for _ in range(3001)], [10.0 ** r.uniform(-300, 300) for _ in range(200)], [-1e308, 1e308, 0.0, 5.0] * 9,
             [1.0 + i * 2 ** -52 for i in range(60)], [float(r.randint(0, 5)) for _ in range(100)]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert rp.exact_median(df, "v") == df.agg(F.percentile("v", 0.5)).first()[0], values[:5]
    assert rp.exact_median(spark.createDataFrame([], "v double"), "v") is None
