"""Every registered query against its DuckDB oracle on the smallest scale,
plus the flagship entry point and plan-shape checks."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLES[name], SF_SMALL, con)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["hash_match"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "text"]
    assert df.count() > 0


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["detect_pipeline", "explain_words", "span_to_node", "merge_sources",
                                  "redact_documents", "apply_corrections"])
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _physical(QUERIES[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_prunes_columns(spark):
    df = QUERIES["batch_progress"](spark, SF_SMALL)
    plan = _physical(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
