"""H7: corrections applied as they arrive, with keyed state.

A stateful operator keeps, for each review session, its detections, the undo stack and the last action
applied, in the state store; a micro-batch reads and writes the state of the sessions it touches and
nothing else, however long the log has grown.  Actions are applied in the order of their number: a repeated one is
ignored, one that comes before its predecessor waits in the state, and a predecessor that has not come by the time the
watermark passes the waiting action is given up (event-time timer).  What changes comes out as
rows of a keyed table, deletions included (``deleted``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import spans as sp
from ..functions import tables as tb
from ..operators import review as rv

#: a detection in the state and in the output
DET_FIELDS = ("doc_id bigint, text string, char_start bigint, char_end bigint, type string, confidence double, status string, "
              "reason string, source string, status_before_review string, action_mode string, custom_replacement string, deleted boolean, born bigint")
OUT_SCHEMA = f"session_id string, det_id string, {DET_FIELDS}, upto bigint"
_NAMES = [f.strip().split(" ")[0] for f in DET_FIELDS.split(",")]
_ACTION = [f.strip().split(" ")[0] for f in rv.LOG_SCHEMA.split(",")]
_ADD = ("doc_id", "text", "char_start", "char_end", "type")


def _plain(value):
    """A pandas cell as a Python value (None for any missing one)."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


class Review:
    """A session's detections (id to dict), undo stack and the rules of the actions.  An entry of the stack holds
    (id, incarnation, status before) of what an action changed."""

    def __init__(self, dets: dict[str, dict], stack: list):
        self.dets, self.stack, self.changed = dets, stack, set()

    def _set(self, entry: list, det_id: str, status: str | None) -> None:
        det = self.dets[det_id]
        entry.append([det_id, det["born"], det["status"]])
        det["status"] = status
        self.changed.add(det_id)

    def apply(self, seq: int, act: dict) -> None:
        kind, entry = act["action"], []
        det = self.dets.get(act["det_id"])
        if kind == "add":
            if act["det_id"] is not None:
                self._add(seq, act)
        elif kind == "delete":
            if det is not None and not det["deleted"]:
                det["deleted"] = True
                self.changed.add(act["det_id"])
        elif kind == "undo":
            for det_id, born, status in self.stack.pop() if self.stack else ():
                if self.dets[det_id]["born"] == born:
                    self.dets[det_id]["status"] = status
                    self.changed.add(det_id)
        elif kind == "update":
            if det is not None:
                for field in ("action_mode", "custom_replacement"):
                    if act[field] is not None:
                        det[field] = act[field]
                if act["status"] is not None:
                    self._set(entry, act["det_id"], act["status"])
                self.changed.add(act["det_id"])
        elif kind in rv.UNDOABLE:
            wide = kind.endswith("_global")
            for det_id, det in self.dets.items():
                if not wide and det["doc_id"] != act["doc_id"]:
                    continue
                if kind.startswith("bulk_accept"):
                    if det["status"] == "missed" and act["threshold"] is not None and det["confidence"] >= act["threshold"]:
                        self._set(entry, det_id, "redacted")
                elif det["status"] in ("missed", "false_positive"):
                    self._set(entry, det_id, act["status"] if kind == "bulk_update" else "dismissed")
        if kind in rv.UNDOABLE:
            self.stack = [*self.stack, entry][-tb.UNDO_DEPTH:]

    def _add(self, seq: int, act: dict) -> None:
        before = self.dets.get(act["det_id"], {})
        self.dets[act["det_id"]] = {
            **{k: act[k] for k in _ADD}, "confidence": 1.0, "status": "redacted", "reason": tb.MANUAL_REASON, "source": "manual", "status_before_review": "redacted",
            "action_mode": before.get("action_mode"), "custom_replacement": before.get("custom_replacement"), "deleted": False, "born": seq}
        self.changed.add(act["det_id"])


class ReviewProcessor(StatefulProcessor):
    """Keyed by session.  ``patience`` (ms of event time) is how long a waiting action waits for its predecessor."""

    def __init__(self, patience: int = 3_600_000):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.dets = handle.getMapState("dets", "det_id string", DET_FIELDS)
        self.stack = handle.getValueState("stack", "entries string, last bigint")
        self.waiting = handle.getMapState("waiting", "at bigint", "action string, due bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            det = {k: _plain(row.get(k)) for k in _NAMES} | {"status_before_review": _plain(row["status"]), "deleted": False, "born": 0}
            self.dets.updateValue((row["det_id"],), tuple(det[k] for k in _NAMES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stack, last = self._undo()
        held, fresh = self._held(), {}
        for part in rows:
            for row in part.to_dict("records"):
                seq, at = _plain(row["seq"]), row["event_time"]
                if seq is None or seq <= last or int(seq) in held or int(seq) in fresh:
                    continue
                due = int(pd.Timestamp(at).timestamp() * 1000) + self.patience if _plain(at) is not None else 0
                fresh[int(seq)] = ({k: _plain(row[k]) for k in _ACTION}, due)
        yield from self._advance(key, timerValues, False, stack, last, held, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, True, *self._undo(), self._held(), {})

    def _undo(self) -> tuple[list, int]:
        kept = self.stack.get()
        return (json.loads(kept[0]), int(kept[1])) if kept is not None else ([], 0)

    def _held(self) -> dict[int, tuple[dict, int]]:
        """The waiting actions of the state."""
        return {int(k[0]): (json.loads(v[0]), int(v[1])) for k, v in self.waiting.iterator()}

    def _advance(self, key, timerValues, late: bool, stack: list, last: int, held: dict, fresh: dict) -> Iterator[pd.DataFrame]:
        """Applies the waiting actions (``held`` by the state, and ``fresh``) that follow each other; after the deadline of one, also those behind a
        gap.  Every call of the state costs a way to the JVM and back, so only what goes on waiting is put there."""
        waiting = [(seq, *x) for seq, x in sorted((held | fresh).items(), key=lambda x: x[0])]
        now, ready = timerValues.getCurrentWatermarkInMs() if late else 0, []
        overdue = max((seq for seq, _, due in waiting if late and due <= now), default=0)
        upto = last
        for seq, act, _ in waiting:
            if seq != upto + 1 and seq > overdue:
                break
            ready.append((seq, act))
            upto = seq
        if ready:
            review = Review({k[0]: dict(zip(_NAMES, map(_plain, v), strict=True)) for k, v in self.dets.iterator()}, stack)
            for seq, act in ready:
                review.apply(seq, act)
                if seq in held:
                    self.waiting.removeKey((seq,))
            for det_id in review.changed:
                self.dets.updateValue((det_id,), tuple(review.dets[det_id][k] for k in _NAMES))
            self.stack.update((json.dumps(review.stack), upto))
            out = [{"session_id": key[0], "det_id": d, **review.dets[d], "upto": upto} for d in sorted(review.changed)]
            if out:
                frame = pd.DataFrame(out, columns=["session_id", "det_id", *_NAMES, "upto"])
                yield frame.astype({c: "Int64" for c in ("doc_id", "char_start", "char_end", "born", "upto")})
        for seq, (act, due) in fresh.items():
            if seq > upto:
                self.waiting.updateValue((seq,), (json.dumps(act), due))
        if held:  # a timer stands only where actions wait
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        rest = [due for seq, _, due in waiting if seq > upto]
        if rest:
            self.handle.registerTimer(min(rest))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Several state variables of a key need the RocksDB store; its snapshots lie in the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_corrections(log: DataFrame, dets: DataFrame, doc_sessions: DataFrame, patience: int = 3_600_000, watermark: str = "1 hour") -> DataFrame:
    """The changes (OUT_SCHEMA) that a stream of actions (LOG_SCHEMA and event_time) makes to the detections ``dets``; each is reviewed by
    the session of its document (of several the first by name).  Update mode: a row is the newest state of its detection, up to the
    action ``upto`` of the session; ``deleted`` rows are gone."""
    use_state_store(log.sparkSession)
    session = doc_sessions.groupBy("doc_id").agg(F.min("session_id").alias("session_id"))
    mine = dets.select("doc_id", "det_id", "text", "char_start", "char_end", "type", "confidence", "status", "reason", "source").join(session, "doc_id")
    none = F.lit(None).cast("string")
    mine = mine.withColumns({"action_mode": none, "custom_replacement": none})
    # an add has the id of its span; one to a document of another session has none and adds nothing
    own = session.select(F.col("doc_id").alias("own_doc"), F.col("session_id").alias("own_session"))
    log = log.join(own, F.col("doc_id") == F.col("own_doc"), "left").withColumn("det_id", F.when(F.col("action") != "add", F.col("det_id")).when(
        F.col("own_session") == F.col("session_id"), sp.det_id(F.col("doc_id"), F.col("char_start"), F.col("char_end"), F.col("type"))))
    actions = log.select(*_ACTION, F.col("event_time").cast("timestamp").alias("event_time")).filter("session_id IS NOT NULL").withWatermark("event_time", watermark)
    return actions.groupBy("session_id").transformWithStateInPandas(
        ReviewProcessor(patience), OUT_SCHEMA, "Update", "EventTime", initialState=mine.groupBy("session_id"))


def reviewed(dets: DataFrame, changes: DataFrame) -> DataFrame:
    """The detections after review: ``changes`` holds the last change of each (session, detection) at most, as ``read_changes`` gives
    them; unchanged detections as they were, deleted ones gone."""
    cols = [n for n in _NAMES if n not in ("deleted", "born")]
    none = F.lit(None).cast("string")
    plain = dets.join(changes.select("det_id"), "det_id", "left_anti").withColumns(
        {"status_before_review": F.col("status"), "action_mode": none, "custom_replacement": none})
    return plain.select("det_id", *cols).unionByName(changes.filter("NOT deleted").select("det_id", *cols))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The last change of each detection in the keyed table that ``stream.upsert_batch`` writes."""
    rows = spark.read.schema(f"{OUT_SCHEMA}, batch_id bigint").parquet(path)
    keys = ["session_id", "det_id"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("batch_id", "upto")).alias("r"))
    return last.select(*keys, "r.*").drop("batch_id")
