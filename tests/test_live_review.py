"""Corrections as composable summaries and as keyed state: both equal the plain fold."""

import os
import random
import time

from pyspark.sql import functions as F

from spanveil.functions import tables as tb
from spanveil.operators import review as rv
from spanveil.operators.compose import fold_tree
from spanveil.streaming import live_review as lr
from spanveil.streaming import stream as sm
from tests.test_review import _mock, py_cancelled

DETS = ("doc_id long, det_id string, text string, char_start long, char_end long, type string, confidence double, status string, reason string, source string")


def test_one_session_of_a_million_actions(spark):
    """No array holds the session: runs of 256 places are merged level by level."""
    n = 1_000_000
    rows = spark.range(1, n + 1).selectExpr("'hot' AS session_id", "id AS seq", "CASE WHEN pmod(xxhash64(id), 100) < 48 THEN 'undo' WHEN pmod(id, 977) = 0 "
                                            "THEN 'add' ELSE 'update' END AS action")
    got = sorted(r.seq for r in rv.cancelled_actions(rows).select("seq").toLocalIterator())
    stack, undone = [], []
    for r in rows.select("seq", "action").toArrow().to_pylist():
        if r["action"] == "undo":
            if stack:
                undone.append(stack.pop())
        elif r["action"] == "update":
            stack = (stack + [r["seq"]])[-tb.UNDO_DEPTH:]
    assert got == sorted(undone) and len(got) > 300_000


def test_sessions_with_gaps_and_any_depth(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for depth in (1, 3, 20):
        for sess in range(12):
            name = f"{depth}-{sess}"
            seqs = sorted(rnd.sample(range(-50, 10 ** rnd.choice([3, 6, 12])), 300))
            acts = [(q, rnd.choice(["update", "bulk_accept", "undo", "add"] if sess % 2 else ["update", "undo", "undo"])) for q in seqs]
            want[name] = (depth, py_cancelled(acts, depth))
            rows += [(depth, name, q, a) for q, a in acts]
    log = spark.createDataFrame(rows, "depth int, session_id string, seq long, action string")
    for depth in (1, 3, 20):
        got = {}
        for r in rv.cancelled_actions(log.filter(F.col("depth") == depth), depth).collect():
            got.setdefault(r.session_id, []).append(r.seq)
        assert {k: sorted(v) for k, v in got.items()} == {k: w for k, (d, w) in want.items() if d == depth and w}
    assert rv.cancelled_actions(log.limit(0)).count() == 0


def test_fold_tree_keeps_the_order(spark):
    rows = spark.range(5000).selectExpr("pmod(id, 3) AS k", "id * 7 AS place", "named_struct('s', cast(id AS string)) AS e")
    out, none = fold_tree(rows, ["k"], "named_struct('s', concat_ws(',', nullif(_a.s, ''), _x.s))", "named_struct('s', '')", bits=4)
    assert none is None
    assert {r.k: r.e.s for r in out.collect()} == {k: ",".join(str(i) for i in range(k, 5000, 3)) for k in range(3)}


def python_replay(dets, log):
    """One session's log applied action by action, by the rules and without state or trees."""
    undone = set(py_cancelled([(a["seq"], a["action"]) for a in log]))
    rows = {d["det_id"]: dict(d, born=0, mode=None, custom=None) for d in dets}
    modes = {}
    for a in sorted(log, key=lambda a: a["seq"]):
        if a["action"] == "add":
            rows[a["det_id"]] = {"det_id": a["det_id"], "doc_id": a["doc_id"], "status": "redacted", "confidence": 1.0, "born": a["seq"]}
        elif a["action"] == "delete":
            rows.pop(a["det_id"], None)
        elif a["action"] == "update":
            for k in ("action_mode", "custom_replacement"):
                if a[k] is not None:
                    modes.setdefault(a["det_id"], {})[k] = a[k]
        if a["seq"] in undone:
            continue
        for i, d in rows.items():
            kind = a["action"]
            if kind == "update" and i == a["det_id"] and a["status"] is not None:
                d["status"] = a["status"]
            elif kind in ("bulk_accept", "bulk_accept_global") and (kind.endswith("global") or d["doc_id"] == a["doc_id"]):
                if d["status"] == "missed" and d["confidence"] >= a["threshold"]:
                    d["status"] = "redacted"
            elif kind == "bulk_update" and d["doc_id"] == a["doc_id"] and d["status"] in ("missed", "false_positive"):
                d["status"] = a["status"]
            elif kind == "bulk_reject_global" and d["status"] in ("missed", "false_positive"):
                d["status"] = "dismissed"
    return {i: (d["status"], modes.get(i, {}).get("action_mode"), modes.get(i, {}).get("custom_replacement")) for i, d in rows.items()}


def case(spark, seed, n=120):
    """Detections of six documents in two sessions, and their logs."""
    rnd = random.Random(seed)
    dets = [{"doc_id": d, "det_id": f"{d}-{i}", "text": "t", "char_start": 10 * i, "char_end": 10 * i + 5, "type": "X", "confidence": rnd.choice([0.3, 0.5, 0.9]),
             "status": rnd.choice(["missed", "redacted", "false_positive"]), "reason": "r", "source": "model"} for d in range(6) for i in range(5)]
    spans = {(d, s): rv.manual_detections(spark.createDataFrame([(d, s, s + 3, "abc", "CUSTOM")], "doc_id long, char_start long, char_end long, text string, type string"))
             .first().det_id for d in range(2) for s in (100, 200)}
    logs = {}
    for sess in ("s0", "s1"):
        docs = [0, 1, 2] if sess == "s0" else [3, 4, 5]
        log = []
        for seq in range(1, n + 1):
            kind = rnd.choice([*rv.UNDOABLE, "update", "undo", "undo", "add", "delete"])
            doc = rnd.choice(docs)
            a = dict(session_id=sess, seq=seq, doc_id=doc, action=kind, det_id=None, status=None, action_mode=None, custom_replacement=None, threshold=None,
                     char_start=None, char_end=None, text=None, type=None)
            known = [d["det_id"] for d in dets if d["doc_id"] in docs] + [v for (d, _), v in spans.items() if d in docs]
            if kind in ("update", "delete"):
                a["det_id"] = rnd.choice([*known, "unknown"])
            if kind == "update":
                a["status"] = rnd.choice(["missed", "redacted", "dismissed", "false_positive"])
                a["action_mode"], a["custom_replacement"] = rnd.choice([None, "redact", "anonymize"]), rnd.choice([None, "c1", "c2"])
            if kind == "bulk_update":
                a["status"] = rnd.choice(["missed", "dismissed", "false_positive"])
            if kind.startswith("bulk_accept"):
                a["threshold"] = rnd.choice([0.4, 0.6])
            if kind == "add":
                # sometimes to a document of the other session: that adds nothing
                at = rnd.choice(sorted(spans))
                a.update(doc_id=at[0], char_start=at[1], char_end=at[1] + 3, text="abc", type="CUSTOM", det_id=spans[at])
            log.append(a)
        logs[sess] = log
    sessions = spark.createDataFrame([(d, "s0" if d < 3 else "s1") for d in range(6)], "doc_id long, session_id string")
    want = {}
    for sess, log in logs.items():
        docs = (0, 1, 2) if sess == "s0" else (3, 4, 5)
        want |= python_replay([d for d in dets if d["doc_id"] in docs], [a if a["action"] != "add" or a["doc_id"] in docs else dict(a, action="none") for a in log])
    rows = [tuple(a[c.split(" ")[0]] for c in rv.LOG_SCHEMA.split(", ")) for log in logs.values() for a in log]
    return (spark.createDataFrame([tuple(d[c.split(" ")[0]] for c in DETS.split(", ")) for d in dets], DETS),
            spark.createDataFrame(rows, rv.LOG_SCHEMA), sessions, want)


def outcome(df):
    rows = df.collect()
    out = {r.det_id: (r.status, r.action_mode, r.custom_replacement) for r in rows}
    assert len(out) == len(rows)  # a detection stands once
    return out


def test_replay_equals_the_plain_fold(spark):
    for seed in (1, 2):
        dets, log, sessions, want = case(spark, seed)
        assert outcome(rv.replay(dets, log.unionByName(log.limit(30)), sessions)) == want


def _stream(spark, log, dets, sessions, root, patience=3_600_000):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "in"))
        q = (lr.live_corrections(stream, dets, sessions, patience, "10 seconds").writeStream.outputMode("update").foreachBatch(sm.upsert_batch(os.path.join(root, "out")))
             .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return lr.reviewed(dets, lr.read_changes(spark, os.path.join(root, "out")))


def test_stream_of_micro_batches_equals_the_plain_fold(spark, tmp_path):
    """Five files out of order with repeats, stopped after three and started again: deletes, undo and adds come out right."""
    dets, log, sessions, want = case(spark, 3)
    log = log.withColumn("event_time", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq")))
    parts = [log.filter("seq <= 30"), log.filter("seq > 60 AND seq <= 90"), log.filter("seq > 20 AND seq <= 60"), log.filter("seq > 100 OR seq < 5"), log.filter("seq > 85")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
        if i == 2:
            _stream(spark, log, dets, sessions, str(tmp_path))
    assert outcome(_stream(spark, log, dets, sessions, str(tmp_path))) == want


def test_a_missing_action_is_given_up(spark, tmp_path):
    """Action 2 never comes: 3 waits until the watermark has passed it by the patience, then counts."""
    dets, sess = _mock(spark), spark.createDataFrame([(1, "s")], "doc_id long, session_id string")
    none = dict.fromkeys(c.split(" ")[0] for c in rv.LOG_SCHEMA.split(", "))
    rows = [(1, 1, "update", "d2", "dismissed"), (3, 3, "delete", "d0", None), (900, 4, "update", "d3", "redacted"), (5000, 5, "update", "d6", "redacted")]
    states = []
    for at, seq, action, det, status in rows:
        row = none | {"session_id": "s", "seq": seq, "doc_id": 1, "action": action, "det_id": det, "status": status}
        log = spark.createDataFrame([tuple(row.values())], rv.LOG_SCHEMA).withColumn("event_time", F.timestamp_seconds(F.lit(1_704_067_200 + at)))
        log.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        states.append({k: v[0] for k, v in outcome(_stream(spark, log, dets, sess, str(tmp_path), patience=60_000)).items()})
    assert states[0]["d2"] == "dismissed" and "d0" in states[1]
    assert "d0" not in states[-1] and states[-1]["d3"] == "redacted" and states[-1]["d6"] == "redacted"
