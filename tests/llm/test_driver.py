"""How long the plans are that the driver plans anew after every stage: its memory holds them, however small the input."""

from spanveil.llm import components, decontaminate, jaccard_join
from spanveil.session import cut_lineage

from . import brute


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def recorded(monkeypatch, module, name):
    """The leaves of every plan that ``module`` writes by ``name``."""
    seen, write = [], getattr(module, name)

    def noted(df, *args, **kwargs):
        seen.append(leaves(df))
        return write(df, *args, **kwargs)
    monkeypatch.setattr(module, name, noted)
    return seen


def test_a_round_of_the_components_names_its_edges_few_times(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 4), (7, 7)], "u long, v long")
    large = components._large_star(edges)
    assert leaves(large) <= 2 and leaves(components._small_star(large)) <= 4
    assert sorted(map(tuple, large.collect())) == [(2, 1), (3, 1), (4, 2), (5, 3), (9, 8)]
    forked = edges.unionByName(spark.createDataFrame([(1, 5)], "u long, v long"))
    assert sorted(map(tuple, components._small_star(forked).collect())) == [(2, 1), (3, 2), (4, 1), (4, 3), (5, 1), (9, 8)]


def test_rounds_do_not_carry_the_plan_of_the_edges(spark, monkeypatch):
    seen = recorded(monkeypatch, components, "cut_measured")
    edges = spark.range(3).selectExpr("id AS u", "id + 1 AS v")
    for _ in range(4):
        edges = edges.unionByName(edges)
    got = components.components(edges, "test-components")
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(4)}
    assert seen and max(seen) <= 4


def test_chunks_name_the_families_twice(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 1)
    members = spark.createDataFrame([(0, k, 10, 0 if k < 5 else k) for k in range(9)] + [(1, 20, 10, 20), (1, 21, 10, 20)], "root long, node long, n int, comp long")
    rows = jaccard_join._chunk_rows(members)
    assert leaves(rows) <= 2
    got = [r.asDict() for r in rows.collect()]
    # four nodes outside the largest component, each with each of the nine; a family of one component has nothing to compare
    assert {r["root"] for r in got} == {0} and {r["node"] for r in got if not r["side"]} == {5, 6, 7, 8}
    met = [(a["node"], b["node"]) for a in got for b in got if not a["side"] and b["side"] and (a["i"], a["j"]) == (b["i"], b["j"])]
    assert sorted(met) == [(a, b) for a in range(5, 9) for b in range(9)]


def test_the_search_is_planned_in_parts(spark, monkeypatch):
    item = [f"w{i}" for i in range(20)]
    items = [(1, " ".join(item)), (2, "one two three")]
    rows = [(1, "before " + " ".join(item) + " after"), (2, " ".join(item[:18])), (3, "one two three"), (4, " ".join(f"x{i}" for i in range(30))), (5, None)]
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string"), "test-docs")
    bench = cut_lineage(spark.createDataFrame(items, "item_id long, text string"), "test-items")
    seen = recorded(monkeypatch, decontaminate, "cut_lineage")
    found = decontaminate.contaminated(docs, bench)
    assert max(seen) <= 3 and leaves(found) <= 2 * 3 + 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == set(brute.best_windows([r for r in rows if r[1]], items)) == {(1, 1), (2, 1), (3, 2)}
