"""A keyed table kept by a stream: compaction, replay, lost attempts (H2, H4)."""

import random

import pytest

from spanveil.streaming.keyed_table import KEPT, KeyedTable

SCHEMA = "doc_id long, v string, n map<string,int>"


def _folders(path):
    return [p for p in (path / "data").glob("*") if p.is_dir()], list((path / "manifests").glob("*.json"))


def _got(table):
    return {r.doc_id: r.v for r in table.read().collect()}


def test_many_batches_leave_few_folders(spark, tmp_path):
    rng, want, most = random.Random(3), {}, 0
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4, every=10)
    for b in range(40):
        rows = {rng.choice([None, *range(30)]): f"{b}" for _ in range(rng.randint(0, 4))}
        want |= rows
        table.add(spark.createDataFrame([(k, v, {"x": b}) for k, v in rows.items()], SCHEMA).coalesce(1), b)
        if b % 13 == 5:  # a replayed batch, merged or not, changes nothing
            table.add(spark.createDataFrame([(k, v, {"x": b}) for k, v in rows.items()], SCHEMA), b)
            assert _got(table) == want
        data, manifests = _folders(tmp_path / "t")
        most = max(most, len(data))
        assert len(manifests) <= KEPT
    assert _got(table) == want and most <= 10 + KEPT * 4 + 2
    assert table.manifest()["upto"] == 39 and not table.manifest()["deltas"]
    table.add(spark.createDataFrame([(1, "late", None)], SCHEMA), 12)   # a batch of before the merge: already in
    assert _got(table) == want


def test_a_stopped_attempt_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=2, every=2)
    one = spark.createDataFrame([(1, "a", None), (2, "a", None)], SCHEMA)
    table.add(one, 0)
    before = _got(table)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.add(spark.createDataFrame([(2, "b", None)], SCHEMA), 1)   # data and merge written, no manifest
    assert _got(table) == before
    reader = table.read()                                                   # a reader on its way
    table.add(spark.createDataFrame([(2, "b", None)], SCHEMA), 1)           # the batch is tried again
    assert _got(table) == {1: "a", 2: "b"}
    assert {r.doc_id: r.v for r in reader.collect()} == before
    table.add(spark.createDataFrame([(3, "c", None)], SCHEMA), 2)
    named = {f.split("/")[0] for v in table._versions() for x in [table._read(v)] for f in [*x["deltas"].values(), *x["base"].values()]}
    assert {p.name for p in _folders(tmp_path / "t")[0]} == named           # nothing of the stopped attempt is left


def test_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), every=2)
    with pytest.raises(ValueError):
        table.read()
    for b in range(2):
        table.add(spark.createDataFrame([], SCHEMA), b)
    assert table.read().count() == 0 and table.read().columns == ["doc_id", "v", "n"]
