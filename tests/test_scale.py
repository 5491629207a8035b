"""What a task holds and how many tasks there are, as tables grow."""

import pyarrow as pa
from pyspark.sql import functions as F

from spanveil import session
from spanveil.functions import batches as bt
from spanveil.operators import detect as dt
from spanveil.operators import explain as ex
from spanveil.operators import structure as st
from spanveil.streaming import live_review as lr


def test_slices_hold_a_bounded_number_of_bytes():
    texts = ["x" * n for n in (0, 900, 300, 5000, 10, 10)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array([[1] * 3, None, [], [], [], [1] * 9, []])], names=["i", "t", "l"])
    parts = list(bt.small([batch, batch.slice(0, 0)], 1500))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= 1 or bt.row_bytes(p).sum() <= 1500 for p in parts) and len(parts) > 3


def test_documents_are_the_same_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} mail a{i}@x.io " * (i % 5), "mixed_general") for i in range(60)], "doc_id bigint, text string, policy string")
    whole = sorted(map(str, dt.detect_pipeline(docs).collect()))
    monkeypatch.setattr(dt, "small", lambda b: bt.small(b, 100))
    assert whole and sorted(map(str, dt.detect_pipeline(docs.repartition(1)).collect())) == whole


def test_tasks_grow_with_the_rows_of_a_row_group(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id AS doc_id", "repeat(uuid(), 20) AS text").repartition(1).write.parquet(str(tmp_path / "d"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    try:
        docs = spark.read.parquet(str(tmp_path / "d"))
        cores = spark.sparkContext.defaultParallelism
        assert docs.rdd.getNumPartitions() >= 4 * cores  # yet one row group, read by one task
        spread = session.spread(docs)
        sizes = [r[1] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 5000 and len(sizes) >= 25 and max(sizes) <= 400
        assert session.spread(spread.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_external_explanations_without_a_shuffle_of_words(spark):
    docs = spark.createDataFrame([(1, "the quick brown"), (1, "the quick"), (2, "x@y.io said 1234"), (None, "a b"), (3, None)], "doc_id bigint, text string")
    ext = spark.createDataFrame([(1, 1, "e1", "low", "m"), (1, 1, "e2", None, "m"), (1, 7, "none", "low", "m"), (2, 2, None, "low", "m"), (2, 0, "late", "low", "m"),
                                 (None, 0, "null", "low", "m"), (1, None, "n", "low", "m"), (2, -1, "n", "low", "m")],
                                "doc_id bigint, word_idx int, explanation string, risk_level string, source string")
    found = dt.detect_arrays(docs)
    joined = ex.explain_words(st.words_with_detections(found), ext)
    held = ex.explain_words(st.words_with_detections(found, external=ext))
    assert sorted(map(str, held.collect())) == sorted(map(str, joined.select(held.columns).collect()))
    assert held.filter("word = 'quick'").count() == 4
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("MapInArrow")  # words are made above the join


def test_rules_of_words_with_blanks(spark):
    words = spark.createDataFrame([(" The ", "function"), ("\tHEREBY\n", "legal"), (" 12345 ", "default"), (" 123 ", "number"), (" a ", "short"), (None, "default")], "w string, r string")
    got = words.select("w", "r", ex.unflagged_rule(F.col("w")).alias("got")).collect()
    assert all(x.r == x.got for x in got)


class _State(dict):
    calls = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        _State.calls += 1
        self[k] = v

    def removeKey(self, k):
        _State.calls += 1
        del self[k]


class _Handle:
    def __init__(self):
        self.timers, self.listed = set(), 0

    def listTimers(self):
        self.listed += 1
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class _Value:
    kept = None

    def get(self):
        return self.kept

    def update(self, v):
        self.kept = v


def test_actions_in_order_pass_no_state():
    import pandas as pd
    p = lr.ReviewProcessor(1000)
    p.handle, p.dets, p.waiting, p.stack = _Handle(), _State(), _State(), _Value()
    def rows(*seqs):
        return iter([pd.DataFrame([{**dict.fromkeys(lr._ACTION), "session_id": "s", "seq": s, "doc_id": 1, "action": "undo", "event_time": pd.Timestamp("2024-01-01")} for s in seqs])])
    _State.calls = 0
    list(p.handleInputRows(("s",), rows(2, 1, 2, 3), None))
    assert p.stack.get()[1] == 3 and _State.calls == 0 and not p.handle.listed
    list(p.handleInputRows(("s",), rows(5, 6, 2), None))
    assert sorted(p.waiting) == [(5,), (6,)] and len(p.handle.timers) == 1 and p.stack.get()[1] == 3
    list(p.handleInputRows(("s",), rows(4, 5), None))
    assert not p.waiting and not p.handle.timers and p.stack.get()[1] == 6
