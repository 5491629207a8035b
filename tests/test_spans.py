"""Overlap union (C14), source merge (C12) and word alignment."""

import random

from pyspark.sql import functions as F

from spanveil.operators import detect as dt


def py_union(spans):
    """spans: (start, end, conf, type, ord) in list order."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][4]))
    out = []
    for i in order:
        s, e, c, t, o = spans[i]
        if out and s < out[-1][1]:
            p = out[-1]
            p[1] = max(p[1], e)
            if c > p[2]:
                p[2], p[3] = c, t
        else:
            out.append([s, e, c, t, o])
    return sorted(tuple(x[:4]) for x in out)


def _union(spark, spans):
    rows = [(1, s, e, c, t, o, "x" * (e - s)) for s, e, c, t, o in spans]
    df = spark.createDataFrame(rows, "doc_id long, char_start long, char_end long, confidence double, type string, "
                                     "ord long, text string")
    got = dt.merge_overlaps(df, ("ord",)).collect()
    return sorted((r.char_start, r.char_end, r.confidence, r.type) for r in got)


def test_union_cases(spark):
    spans = [(0, 10, 0.5, "A", 0), (5, 15, 0.7, "B", 1), (14, 20, 0.7, "C", 2),   # chained, tie keeps B
             (20, 25, 0.9, "D", 3),                                               # touching: separate
             (30, 35, 0.6, "E", 4), (30, 33, 0.6, "F", 5),                        # contained, equal conf
             (40, 90, 0.4, "G", 6), (43, 44, 0.8, "H", 7), (80, 100, 0.3, "I", 8)]
    assert _union(spark, spans) == py_union(spans)
    assert (0, 20, 0.7, "B") in py_union(spans) and (20, 25, 0.9, "D") in py_union(spans)


def test_union_random(spark):
    rnd = random.Random(7)
    spans = []
    for o in range(300):
        s = rnd.randrange(0, 2000)
        spans.append((s, s + rnd.randrange(1, 40), round(rnd.random(), 2), rnd.choice("ABCD"), o))
    assert _union(spark, spans) == py_union(spans)


def _docs(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_merge_sources_cases(spark):
    text = "alpha bob@x.org beta 10.0.0.1 gamma delta"
    docs = _docs(spark, text)
    heur = dt.heuristic_detections(docs, with_context=True)
    # model spans: one over the email with lower confidence and missed, one over "gamma", one over the IP (higher)
    i_mail, i_ip, i_g = text.index("bob"), text.index("10.0"), text.index("gamma")
    model = spark.createDataFrame([
        (1, "bob@x", i_mail, i_mail + 5, "EMAIL", 0.6, "missed", "m1", "model", "p", "r"),
        (1, "gamma", i_g, i_g + 5, "PERSON", 0.9, "redacted", "m2", "model", "p", "r"),
        (1, "10.0.0", i_ip, i_ip + 6, "IP", 0.99, "redacted", "m3", "model", "p", "r"),
    ], "doc_id long, text string, char_start long, char_end long, type string, confidence double, status string, "
       "reason string, source string, policy string, rule string")
    model = dt.attach_context(model, docs)
    m = {r.char_start: r for r in dt.merge_sources(model, heur).collect()}
    mail = m[i_mail]
    assert mail.char_end == i_mail + len("bob@x.org") and mail.confidence == 0.97
    assert mail.status == "redacted" and mail.source == "dual" and mail.reason.endswith("Also matched by heuristic pattern.")
    assert mail.type == "EMAIL"
    ip = m[i_ip]
    assert ip.confidence == 0.99 and ip.source == "dual" and ip.reason == "m3" and ip.char_end == i_ip + 8
    assert m[i_g].source == "model"


def test_align_expands_and_drops_punctuation(spark):
    text = "see john.smith@mail.com. next"
    docs = _docs(spark, text)
    s = text.index("smith")
    spans = spark.createDataFrame([(1, s, s + 3, "X", 0.9, "redacted", "r", "model", None, None, 0, 0)],
                                  "doc_id long, char_start long, char_end long, type string, confidence double, "
                                  "status string, reason string, source string, policy string, rule string, "
                                  "grp int, ord long")
    a = dt.align_words(dt.attach_context(spans, docs)).collect()[0]
    assert a.text == "john.smith@mail.com"
    # a span covering the final dot keeps the token but drops the trailing '.'
    s2 = text.index("john")
    spans2 = spans.withColumn("char_start", F.lit(s2).cast("long")).withColumn("char_end", F.lit(s2 + 20).cast("long"))
    a2 = dt.align_words(dt.attach_context(spans2, docs)).collect()[0]
    assert a2.text == "john.smith@mail.com"


def py_merge(model, heur):
    """One heuristic span at a time into the growing list, as a plain loop."""
    out = [dict(m) for m in model]
    for h in heur:
        for m in out:
            if h["char_start"] < m["char_end"] and m["char_start"] < h["char_end"]:
                m["char_start"], m["char_end"] = min(m["char_start"], h["char_start"]), max(m["char_end"], h["char_end"])
                if h["confidence"] > m["confidence"]:
                    m["confidence"] = h["confidence"]
                    m["reason"] += " | Also matched by heuristic pattern."
                    if h["status"] == "redacted":
                        m["status"] = "redacted"
                m["source"] = "dual"
                break
        else:
            out.append(dict(h))
    return out


def test_merge_equals_a_sequential_model():
    from spanveil.functions import docspans as ds
    rnd = random.Random(11)

    def span(source, i):
        s = rnd.randrange(0, 120)
        c = round(rnd.random(), 1)
        return {"char_start": s, "char_end": s + rnd.randrange(1, 15), "confidence": c, "type": rnd.choice("AB"), "reason": f"{source}{i}",
                "status": "redacted" if c > 0.6 else "missed", "source": source, "ord": i}
    for _ in range(300):
        model = sorted((span("model", i) for i in range(rnd.randrange(6))), key=lambda s: s["char_start"])
        for i, m in enumerate(model):
            m["ord"] = i
        heur = [span("heuristic", i) for i in range(rnd.randrange(10))]
        got = [{k: v for k, v in s.items() if k != "grp"} for s in ds.merge_sources(model, heur)]
        assert got == py_merge(model, heur)


def test_two_heuristics_in_one_run_become_dual(spark):
    docs = spark.createDataFrame([(1, "mail ann@10.0.0.1.example.com now")], "doc_id long, text string")
    out = dt.detect_pipeline(docs).collect()
    assert [(r.text, r.source) for r in out] == [("ann@10.0.0.1.example.com", "dual")]


def test_unknown_policy_keeps_its_name(spark):
    docs = spark.createDataFrame([(0, "write to ann@x.org", "of_our_own")], "doc_id long, text string, policy string")
    assert {r.policy for r in dt.detect_pipeline(docs).collect()} <= {"of_our_own", None}
    r = dt.resolve_policies(docs.select("doc_id", "policy")).first()
    assert (r.policy, r.threshold, r.rule) == ("of_our_own", 0.5, "mask_full")


def test_pipeline_is_one_narrow_stage(spark):
    docs = spark.createDataFrame([(0, "write to ann@x.org", "finance")], "doc_id long, text string, policy string")
    assert "Exchange" not in dt.detect_pipeline(docs)._jdf.queryExecution().executedPlan().toString()


def test_long_documents(spark):
    import time
    spans = " ".join(f"a{i}@x.org" for i in range(40_000))
    texts = [spans, "a." * 500_000 + " ann@x.org", "x" * 1_000_000, ",".join(f"a{i}@x.org" for i in range(1000)) * 10,
             "mail ann@x." + "org." * 40_000 + "com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id").cache()
    docs.count()
    t = time.time()
    n = {r.doc_id: r.n for r in dt.detect_pipeline(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n[0] == 40_000 and n[1] == 1 and 2 not in n and time.time() - t < 60


def test_patterns_that_match_nothing_are_refused():
    import pytest
    with pytest.raises(ValueError, match="empty string"):
        dt.matcher([("bad", "a*", "T", 0.9, "")])
