"""Jaccard join, decontamination, neighbours: against brute force."""

import random

import numpy as np
import pytest

from spanveil.llm import components, decontaminate, jaccard_join, neighbours

from . import brute

SCHEMA = "doc_id long, text string"


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    line = " ".join(r.choices(vocab, k=30))
    rows, n = [], 0
    for g in range(14):
        base = r.choices(vocab, k=r.choice([6, 9, 30, 80, 200]))
        for _ in range(r.choice([1, 3, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, " ".join(w) + (" " + line if g % 3 == 0 else "")))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "two one"), (None, rows[0][1]),
             (rows[1][0], rows[1][1]), (n + 6, "x " * 5000)]
    return rows


@pytest.fixture(scope="module")
def jaccard_case(spark):
    rows = corpus()
    return spark.createDataFrame(rows, SCHEMA), brute.jaccard_components(rows)


@pytest.mark.parametrize("limits", [{}, {"rare": 2, "long": 40, "small_bucket": 2}, {"rare": 1, "long": 10_000, "small_bucket": 3}])
def test_jaccard_components(jaccard_case, limits):
    docs, expected = jaccard_case
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, **limits).collect()), key=repr)
    assert got == expected


def test_jaccard_keeps_one_of_each(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(5, a, "k"), (3, a.upper(), "k"), (3, a, "k"), (9, "other words are here now", "s"), (9, "a second text under nine", "s"),
            (1, None, None), (1, "", None), (None, a, None), (7, a + " x", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted((tuple(r) for r in jaccard_join.one_of_each(docs).collect()), key=repr)
    threes = [r for r in kept if r[0] == 3]
    assert len(threes) == 1 and threes[0][1].lower() == a
    assert [r for r in kept if r[0] != 3] == sorted([(1, "", None), (1, None, None), (9, "a second text under nine", "s"),
                                                     (9, "other words are here now", "s"), (None, a, None)], key=repr)


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (101, 100)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)}


def test_decontaminate(spark):
    r = random.Random(1)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([3, 8, 30, 60])))) for i in range(12)] + [(50, None), (51, ""), (52, "the the the the the the")]
    docs = []
    for d in range(40):
        w = r.choices(vocab, k=r.choice([0, 5, 100, 400]))
        if d % 2:
            p = r.choice(items)[1] or "x"
            p = p.split()
            if d % 4 == 1 and len(p) > 20:
                p[r.randrange(len(p))] = "changed"
            if d % 4 == 3 and len(p) > 20:
                p.insert(len(p) // 2, "put in")
            at = r.randrange(len(w) + 1)
            w[at:at] = " ".join(p).upper().split()
        docs.append((d, " ".join(w)))
    docs += [(90, None), (91, "the " * 50), (None, items[0][1])]
    got = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start) for x in decontaminate.contaminated(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {k: (round(s, 9), at) for k, (s, at) in brute.best_windows([d for d in docs if d[0] is not None], items).items()}
    assert got == want and len(want) >= 12


def test_decontaminate_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], SCHEMA)
    assert decontaminate.contaminated(docs, none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs.unionAll(docs), items.unionAll(items)).count() == 1


def test_every_fingerprint_within_the_radius_shares_a_block(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        rows.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "i int, a long, b long")
    left = decontaminate.blocks(df.selectExpr("i", "a AS fingerprint"), decontaminate.RADIUS)
    right = decontaminate.blocks(df.selectExpr("i", "b AS fingerprint"), decontaminate.RADIUS)
    assert left.join(right, ["i", "block", "bits"]).select("i").distinct().count() == 300


def brute_nearest(rows, k=5):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            s = [(-float((x * q).sum() / np.sqrt((x * x).sum()) / np.sqrt((q * q).sum())), j) for j, x in ok if j != i and len(x) == len(q)]
            out[i] = sorted((round(a, 9), j) for a, j in s)[:k]
    return out


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(16).round(3).tolist()) for i in range(900)]
    rows += [(i, [1.0] * 16) for i in range(900, 960)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] + [0.0] * 14), (2200, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows)
    for block, parts in ((8192, 1024), (200, 7)):
        got = {}
        for x in neighbours.nearest(df, df.filter("vec_id % 50 = 0"), block=block, query_block=parts).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((round(-x.score, 9), x.vec_id))
        assert set(got) == {q for q, v in want.items() if v}
        assert got[900] == want[900] and got[950] == want[950]  # sixty equal vectors: ties by id
        hits = sum(len(set(got[q]) & set(want[q])) for q in got)
        assert hits >= 0.9 * sum(len(want[q]) for q in got)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id = 0")).collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in got] == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
