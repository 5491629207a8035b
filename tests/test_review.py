"""Review log, undo, bulk actions, triage and reports on the golden fixture."""

import random

from pyspark.sql import functions as F

from spanveil.operators import reports as rp
from spanveil.operators import review as rv

# Golden fixture: the eight scenario detections (text, start, end, type, confidence, status).
MOCK = [("Arjun Sharma", 0, 12, "NAME", 0.95, "redacted"),
        ("arjun.sharma@lawfirm.in", 21, 44, "EMAIL", 0.97, "redacted"),
        ("9876543210", 70, 80, "PHONE", 0.38, "missed"),
        ("Monday", 105, 111, "DATE", 0.28, "false_positive"),
        ("12/03/1990", 130, 140, "DATE", 0.91, "redacted"),
        ("ABCDE1234F", 160, 170, "PAN", 0.99, "redacted"),
        ("123 MG Road, Bangalore", 190, 212, "ADDRESS", 0.52, "false_positive"),
        ("192.168.1.1", 230, 241, "IP", 0.85, "redacted")]


def _mock(spark):
    rows = [(1, f"d{i}", t, s, e, ty, c, st, "r", "model") for i, (t, s, e, ty, c, st) in enumerate(MOCK)]
    return spark.createDataFrame(rows, "doc_id long, det_id string, text string, char_start long, char_end long, "
                                       "type string, confidence double, status string, reason string, source string")


def test_golden_counts_score_gate(spark):
    d = _mock(spark)
    c = rp.status_counts(d).collect()[0]
    assert (c.total, c.redacted, c.missed, c.false_positive, c.dismissed, c.reviewed, c.progress) == (8, 5, 1, 2, 0, 5, 88)
    s = rp.safety_score(rp.status_counts(d)).collect()[0]
    assert (s.grade, s.score) == ("C", 63)
    assert rp.export_gate(rp.status_counts(d)).count() == 0
    assert rp.file_badges(rp.status_counts(d)).collect()[0].badge == "1 pending"


def test_golden_triage(spark):
    t = rv.triage_order(_mock(spark)).orderBy("triage_rank").collect()
    assert [r.text for r in t] == ["9876543210", "Monday", "123 MG Road, Bangalore"]
    n = {r.det_id: (r.next_det_id, r.prev_det_id) for r in rv.triage_neighbours(_mock(spark)).collect()}
    assert n["d2"] == ("d3", "d6") and n["d6"] == ("d2", "d3")


def test_bulk_actions(spark):
    d = _mock(spark)
    acc = {r.det_id: r.status for r in rv.bulk_accept(d, 0.3).collect()}
    assert acc["d2"] == "redacted" and acc["d3"] == "false_positive"
    rej = {r.det_id: r.status for r in rv.bulk_reject(d).collect()}
    assert rej["d2"] == rej["d3"] == rej["d6"] == "dismissed"


def py_cancelled(actions, depth=20):
    stack, cx = [], []
    for seq, act in sorted(actions):
        if act == "undo":
            if stack:
                cx.append(stack.pop())
        elif act in rv.UNDOABLE:
            stack = (stack + [seq])[-depth:]
    return sorted(cx)


def test_undo_against_python_stack(spark):
    rnd = random.Random(3)
    rows, expected = [], {}
    acts = ["update", "update", "bulk_accept", "bulk_reject_global", "add", "delete", "undo", "undo"]
    for sess in range(40):
        seqs = [(i, rnd.choice(acts)) for i in range(80)]
        if sess == 0:   # 25 actions then 25 undos: only the last 20 can be undone
            seqs = [(i, "update") for i in range(25)] + [(25 + i, "undo") for i in range(25)]
        expected[f"s{sess}"] = py_cancelled(seqs)
        rows += [(f"s{sess}", seq, a) for seq, a in seqs]
    log = spark.createDataFrame(rows, "session_id string, seq long, action string")
    got = {}
    for r in rv.cancelled_actions(log).collect():
        got.setdefault(r.session_id, []).append(r.seq)
    for s, exp in expected.items():
        assert sorted(got.get(s, [])) == exp, s
    assert len(expected["s0"]) == 20


def test_replay_status_and_modes(spark):
    d = _mock(spark).withColumn("doc_id", F.lit(1).cast("long"))
    log = spark.createDataFrame([
        ("s", 1, 1, "update", "d2", "redacted", "anonymize", " [P] ", None),
        ("s", 2, 1, "undo", None, None, None, None, None),
        ("s", 3, 1, "bulk_accept", None, None, None, None, 0.5),
        ("s", 4, 1, "update", "d3", "dismissed", None, None, None),
        ("s", 5, 1, "delete", "d0", None, None, None, None),
    ], "session_id string, seq long, doc_id long, action string, det_id string, status string, action_mode string, "
       "custom_replacement string, threshold double")
    for c in ("char_start", "char_end"):
        log = log.withColumn(c, F.lit(None).cast("long"))
    log = log.withColumn("text", F.lit(None).cast("string")).withColumn("type", F.lit(None).cast("string"))
    sess = spark.createDataFrame([(1, "s")], "doc_id long, session_id string")
    out = {r.det_id: r for r in rv.replay(d, log, sess).collect()}
    assert "d0" not in out
    assert out["d2"].status == "missed"              # update undone, bulk accept below threshold (0.38)
    assert out["d2"].action_mode == "anonymize"       # undo restores the status only
    assert out["d3"].status == "dismissed"
    assert out["d6"].status == "false_positive"      # bulk accept touches missed only


def test_add_after_delete_stays(spark):
    d = _mock(spark).limit(0)
    rows = [("s", 1, 1, "add", None, 0, 3, "abc", "CUSTOM"), ("s", 2, 1, "delete", "?", None, None, None, None), ("s", 3, 1, "add", None, 0, 3, "abc", "CUSTOM")]
    log = spark.createDataFrame(rows, "session_id string, seq long, doc_id long, action string, det_id string, char_start long, char_end long, text string, type string")
    for c, t in (("status", "string"), ("action_mode", "string"), ("custom_replacement", "string"), ("threshold", "double")):
        log = log.withColumn(c, F.lit(None).cast(t))
    sess = spark.createDataFrame([(1, "s"), (1, "t")], "doc_id long, session_id string")
    added = rv.replay(d, log.filter("seq = 1"), sess).first().det_id
    log = log.withColumn("det_id", F.when(F.col("action") == "delete", F.lit(added)))
    assert rv.replay(d, log.filter("seq < 3"), sess).count() == 0
    out = rv.replay(d, log, sess).collect()
    assert [(r.det_id, r.status, r.session_id) for r in out] == [(added, "redacted", "s")]


def test_sweep_has_every_threshold(spark):
    out = {r.threshold: r.would_accept for r in rv.threshold_sweep(_mock(spark), [0.3, 0.5]).collect()}
    assert out == {0.3: 1, 0.5: 0}


def test_upsert_replaces_by_span(spark):
    patch = spark.createDataFrame([(1, 1, "mine", 70, 80, "redacted", "98765", "CELL", 1.0), (2, 1, "d3", 0, 0, "dismissed", "x", "y", 0.1)],
                                  "seq long, doc_id long, det_id string, char_start long, char_end long, status string, text string, type string, confidence double")
    out = {r.det_id: r for r in rv.upsert_detections(_mock(spark), patch).collect()}
    assert "d2" not in out and (out["mine"].text, out["mine"].type, out["mine"].status, out["mine"].confidence) == ("98765", "CELL", "redacted", 1.0)
    assert (out["d3"].text, out["d3"].status) == ("Monday", "dismissed")
