"""The registered queries against their oracles, native plans, and the pipeline stage by stage."""

import re

import pytest

import corpus_pipeline
from spanveil.llm import decontaminate, licenses, mixing, quality, sharding
from spanveil.llm.queries import ORACLES, QUERIES
from tests import oracle_harness

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    res = oracle_harness.compare(spark, name, QUERIES[name], ORACLES[name], SF)
    assert res["hash_match"], res


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    files = docs.selectExpr("doc_id", "concat(source, '/', doc_id) AS path", "text")
    for df in (sharding.shard_by_bytes(docs), decontaminate.contaminated(docs, spark.read.parquet(SF + "/benchmark.parquet")),
               licenses.scan_licenses(files), mixing.mix(docs)):
        assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan(df))
        assert "CartesianProduct" not in plan(df)


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, Score int, _node string, `copies` int, C0 string, kept string"


def awkward(spark, near: str):
    """Rows that every stage must take: nulls, an empty text, a repeated id and row, a near copy."""
    rest = (7, 1, "n", 5, "c", "k")
    rows = [(9001, None, "en", "src1", 0, *rest), (9002, "", None, None, None, None, None, None, None, None, None), (3, "words of a repeated id", "en", "src3", 5, *rest),
            (None, "an id that is missing", "en", "src1", 5, *rest), (9003, near, "en", "src1", 5, *rest), (9003, near, "en", "src1", 5, *rest)]
    return spark.createDataFrame(rows, AWKWARD)


def test_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").filter("doc_id < 300")
    near = docs.filter("doc_id = 5").first().text
    docs = docs.selectExpr("*", "1 AS `a.b`", "2 AS Score", "'x' AS _node", "3 AS `copies`", "'y' AS C0", "'z' AS kept")
    for name, stage in corpus_pipeline.STAGES:
        # what an earlier stage dropped comes again, so that each stage meets it
        docs = docs.unionByName(awkward(spark, near)).dropDuplicates() if name != "quality" else docs.unionByName(awkward(spark, near))
        rows = [r.asDict() for r in docs.collect()]
        out = corpus_pipeline.cut_lineage(stage(spark, docs, SF), "test-stage")
        got = [r.asDict() for r in out.collect()]
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "quality":
            net = quality.fit(docs, spark.read.parquet(SF + "/labels.parquet"))
            score = {(r.doc_id, r.text): r.score for r in quality.score_documents(docs.select("doc_id", "text"), net).collect()}
            assert {(r["doc_id"], r["text"]) for r in got} == {k for k, s in score.items() if s >= 0.5} and 0 < len(got) < len(rows)
        elif name == "near_duplicates":
            assert all(r["a.b"] in (1, 7, None) and r["copies"] in (3, 5, None) for r in got)
            want = brute.jaccard_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
            ids = {d for d, n, c in want if d == c}
            assert {r["doc_id"] for r in got} == ids and len(got) < len(rows)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(SF + "/benchmark.parquet").select("item_id", "text").collect()]
            dirty = {d for d, _ in brute.best_windows([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], items)}
            assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r["doc_id"]) for r in rows if r["doc_id"] not in dirty) and dirty
        elif name == "mixing":
            copies = {}
            for r in mixing.mix(docs).collect():
                copies.setdefault(repr(r["doc_id"]), []).append(r["copies"])
            assert len(got) == sum(map(sum, copies.values()))
        else:
            assert len(got) == len(rows) and set(docs.columns) <= set(out.columns)
            assert {r["shard"] for r in got} <= set(range(40))
        docs = out


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
