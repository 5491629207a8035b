"""Replacement text (F2), offset rewrite (F3), segments."""

from pyspark.sql import functions as F

from spanveil.operators import redact as rd
from spanveil.operators import structure as st


def test_replacement_order(spark):
    rows = [("a@b.co", "EMAIL_ADDRESS", None, "  [X]  ", "redact"),
            ("a@b.co", "EMAIL_ADDRESS", None, "   ", "redact"),
            ("a@b.co", "EMAIL_ADDRESS", "highlight_red", None, "anonymize"),
            ("123-45-6789", "US_SSN", "anonymize", None, "redact"),
            ("zz", "US_FOO_BAR", None, None, "anonymize"),
            ("abc", "PHONE_NUMBER", None, None, "redact"),
            ("abc", "PHONE_NUMBER", "redact", None, "highlight")]
    df = spark.createDataFrame(rows, "text string, type string, am string, cr string, gm string")
    got = [r.rep for r in df.select(rd.replacement_text(F.col("text"), F.col("type"), F.col("am"), F.col("cr"),
                                                        F.col("gm")).alias("rep")).collect()]
    assert got == ["[X]", "██████", "a@b.co", "[National ID / SSN]", "[Foo Bar]", "██████", "abc"]


def test_rewrite_and_segments(spark):
    text = "name: Ann Lee, mail ann@x.org, ip 10.0.0.1."
    docs = spark.createDataFrame([(1, text), (2, "no spans here")], "doc_id long, text string")
    spans = [(1, "d1", text.index("Ann"), text.index("Ann") + 7), (1, "d2", text.index("ann@"), text.index("ann@") + 9),
             (1, "d3", text.index("10."), text.index("10.") + 8)]
    dets = spark.createDataFrame(spans, "doc_id long, det_id string, char_start long, char_end long") \
        .withColumn("rep", F.lit("#"))
    out = {r.doc_id: r.text for r in rd.redact_documents(docs, dets).collect()}
    assert out[1] == "name: #, mail #, ip #." and out[2] == "no spans here"
    segs = st.segments(docs, dets).collect()
    for d in (1, 2):
        parts = sorted((r.seg_idx, r.text) for r in segs if r.doc_id == d)
        assert "".join(p for _, p in parts) == (text if d == 1 else "no spans here")


def test_no_confirmed_character_is_left(spark):
    import random
    from spanveil.functions import docspans as ds
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("abcdefgh ") for _ in range(60))
        spans = [(s, s + rnd.randrange(1, 12), "#") for s in (rnd.randrange(0, 50) for _ in range(rnd.randrange(8)))]
        covered = {i for s, e, _ in spans for i in range(s, e)}
        kept = "".join(c for i, c in enumerate(text) if i not in covered)
        assert ds.rewrite(text, spans).replace("#", "") == kept
    docs = spark.createDataFrame([(1, "call John Smith today")], "doc_id long, text string")
    dets = spark.createDataFrame([(1, 5, 15, "A"), (1, 7, 9, "B")], "doc_id long, char_start long, char_end long, rep string")
    assert rd.redact_documents(docs, dets).first().text == "call A today"


def test_short_values_are_masked_whole(spark):
    df = spark.createDataFrame([("123", "mask_partial"), ("4111111111111111", "mask_partial"), ("abc", "mask_full")], "t string, r string")
    got = [r.m for r in df.select(rd.mask_by_rule(F.col("t"), F.col("r")).alias("m")).collect()]
    assert got == ["█" * 6, "█" * 12 + "1111", "█" * 6]


def test_unicode_blanks_and_title_case(spark):
    df = spark.createDataFrame([("  x　", "api-key2b")], "c string, t string")
    r = df.select(rd._strip(F.col("c")).alias("c"), rd.title(F.col("t")).alias("t")).first()
    assert (r.c, r.t) == ("x", "api-key2b".title())
    words = st.word_table(spark.createDataFrame([(1, "ab cd　ef")], "doc_id long, text string")).collect()
    assert [(w.word, w.char_start) for w in words] == [("ab", 0), ("cd", 3), ("ef", 6)]


def test_export_sink_and_error_rows(spark, tmp_path):
    from spanveil.sources import io
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    manifest = spark.createDataFrame([(1, "redact", "redacted_1"), (2, "redact", "redacted_2"), (3, "anonymize", "anonymized_3")],
                                     "doc_id long, export_mode string, out_name string")
    files = io.export_files(docs.withColumn("text", F.upper("text")), manifest)
    assert [r.doc_id for r in files.filter("error IS NOT NULL").collect()] == [2]
    io.write_export(files, str(tmp_path / "out"))
    assert {(r.out_name, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("redacted_1", "A"), ("anonymized_3", "C")}
    assert {r.text for r in io.export_files(None, manifest, originals=True, docs=docs).collect()} == {"a", None, "c"}


def test_every_form_of_href_is_detached(spark):
    from pyspark.sql import functions as F
    from spanveil.operators import redact as rd
    html = ("<a href=\"http://a\">a</a> <a HREF='http://b?x=1'>b</a> <a class=k href = http://c/d>c</a> <a class=\"k\"href=\"e\">e</a> "
            "<div data-href=\"kept\">the word href</div> <area Href=\"\">")
    uris, cleaned = rd.detach_links(F.col("html"))
    r = spark.createDataFrame([(html,), ("no links",), (None,)], "html string").select(uris.alias("u"), cleaned.alias("c")).collect()
    assert r[0].u == ["http://a", "http://b?x=1", "http://c/d", "e", ""] and r[1].u == [] and r[2].u is None
    assert r[0].c == "<a>a</a> <a>b</a> <a class=k>c</a> <a class=\"k\">e</a> <div data-href=\"kept\">the word href</div> <area>"


def _fold(text, pairs):
    for v, r in pairs:
        text = text.replace(v, r) if v else text
    return text


def test_simultaneous_replacement_equals_the_fold():
    import random
    from spanveil.functions import docspans as ds
    r = random.Random(6)
    for round_ in range(400):
        alphabet = r.choice(["ab", "abcdef ", "aé█["])
        text = "".join(r.choices(alphabet, k=r.randint(0, 200)))
        reps = r.choice([["██████"], ["[X]", "[EMAIL]"], ["", "z"], ["ab", "b"], ["zaz"]])
        pairs = [("".join(r.choices(alphabet, k=r.randint(0, 4))), r.choice(reps)) for _ in range(r.choice([3, 12, 60]))]
        assert ds.replace_values(text, pairs) == _fold(text, pairs), (text, pairs)


def test_ten_thousand_values_in_one_document(spark):
    import random
    import time
    from spanveil.functions import docspans as ds
    from spanveil.operators import redact as rd
    r = random.Random(7)
    values = ["".join(r.choices("abcdefghij", k=r.randint(5, 9))) for _ in range(10_000)]
    text = " ".join(r.choice(values) if r.random() < 0.3 else "other" for _ in range(150_000))
    pairs = [(v, "█" * max(6, len(v))) for v in values]
    start = time.perf_counter()
    got = ds.replace_values(text, pairs)
    took = time.perf_counter() - start
    few = pairs[:300]
    start = time.perf_counter()
    _fold(text, few)
    assert took < (time.perf_counter() - start) * 10_000 / 300
    units = spark.createDataFrame([(1, text, "k"), (2, text[:2000], "k"), (3, None, "k"), (4, "no values", "k")], "doc_id long, text string, key string")
    vals = spark.createDataFrame([(d, v, rep, i) for d in (1, 3) for i, (v, rep) in enumerate(pairs)] + [(2, pairs[0][0], None, 0)], "doc_id long, text string, rep string, ord long")
    out = {x.doc_id: x.text for x in rd.redact_by_value(units, vals).collect()}
    assert out == {1: got, 2: None, 3: None, 4: "no values"}
    sample = [(v, rep) for v, rep in pairs if v in text[:3000]]
    assert ds.replace_values(text[:3000], pairs) == _fold(text[:3000], sample)


def test_texts_of_rows_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "call Ann today"), (2, None), (3, "plain"), (4, ""), (5, "not asked for"), (6, "café " * 900), (6, "twice")], "doc_id bigint, text string")
    spans = spark.createDataFrame([(1, 5, 8, "A"), (2, 0, 1, "x"), (5, 0, 3, "y"), (6, 0, 1, "é"), (9, 0, 1, "z")], "doc_id bigint, char_start int, char_end int, rep string")
    rows = spark.createDataFrame([(i, f"f{i}") for i in (1, 1, 2, 3, 4, 6, 7, 9)] + [(None, "f")], "doc_id bigint, out_name string")
    apart = rows.join(rd.redact_documents(docs, spans), "doc_id", "left").select("doc_id", "out_name", "text")
    together = rd.redact_documents(docs, spans, rows=rows)
    assert together.columns == apart.columns and together.count() == 10
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    # spans and texts meet before the one Python stage that rewrites them, none is broadcast by a hint
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and "broadcast" not in plan
    # with ``rows`` the texts travel packed, and come out as they were
    packed = rd.pack_texts(docs)
    assert dict(packed.dtypes)["text"] == "binary"
    assert sorted(map(str, rd.apply_spans(packed.withColumn("_spans", F.lit(None).cast("array<struct<s:int,e:int,rep:string>>"))).collect())) == sorted(map(str, docs.collect()))
    assert packed.filter("doc_id = 6").selectExpr("max(length(text))").first()[0] < 900
    assert max(rd._whole_bytes(b).max() for b in packed._collect_as_arrow() if b.num_rows) > 900 * 6
