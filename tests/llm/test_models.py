"""Toxicity, quality and HTML extraction: held-out accuracy, gradients, and hand-written pages."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanveil.llm import extraction, html_text, labelled, quality, shingles, toxicity, trees
from spanveil.llm.queries import QUERIES


def test_isotonic_is_monotone_and_calibrated():
    r = np.random.default_rng(0)
    s = r.random(500).round(2)
    y = (r.random(500) < s).astype(float)
    x, p = trees.isotonic(s, y)
    assert (np.diff(x) > 0).all() and (np.diff(p) > 0).all()
    assert abs(trees.calibrate((x, p), s).mean() - y.mean()) < 0.05


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    p = trees.Boosted(rounds=40).fit(x[:1500], y[:1500]).raw(x[1500:]) > 0
    assert (p == y[1500:]).mean() > 0.97


def test_conv_gradient_by_differences():
    net = quality.ByteConv.start(3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    r = np.random.default_rng(2)
    units = r.integers(1, 255, (5, 2 * quality.BLOCK + 1, quality.UNIT)).astype(np.uint8)
    doc, y, w = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.ones(3)
    _, grad = net.step(units, doc, y, w)
    for k in net.NAMES:
        a = getattr(net, k)
        at = np.unravel_index(np.abs(grad[k]).argmax(), a.shape)
        old, e = a[at], 1e-5
        a[at] = old + e
        up = net.step(units, doc, y, w)[0]
        a[at] = old - e
        down = net.step(units, doc, y, w)[0]
        a[at] = old
        assert np.isclose((up - down) / (2 * e), grad[k][at], rtol=1e-2, atol=1e-6), k


def test_conv_scores_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    net = quality.ByteConv.start(5)
    texts = ["", None, "short", "é" * 300, "word " * 5000, "x" * 511, "y" * 512, "z" * 513, "a b c " * 90]
    alone = [net.score(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(net.score(pa.array(texts)), alone, atol=1e-6)
    monkeypatch.setattr(quality, "PIECE", 3)
    assert np.allclose(net.score(pa.array(texts)), alone, atol=1e-6)
    assert 0 <= min(alone) and max(alone) <= 1 and len(net.score(pa.array([], pa.string()))) == 0


def test_shingles_of_awkward_texts():
    texts = ["a b c d e", "A  b\tc D", "", "x", None, "b a", " a b ", "é b c d", "w" * 1000 + " q r s", "a b c d"]
    sets = shingles.shingle_sets(pa.array(texts), 4)
    assert [len(s) for s in sets] == [2, 1, 0, 1, 0, 1, 1, 1, 1, 1]
    assert sets[0][0] in sets[1] or sets[0][1] in sets[1]
    assert sets[9][0] == sets[1][0] and sets[5][0] != sets[6][0]
    sliced = shingles.shingle_sets(pa.array(texts)[3:8], 4)
    assert all(np.array_equal(a, b) for a, b in zip(sliced, sets[3:8], strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert sum(b.num_rows for b in shingles.slices(batch, 0, 8)) == len(texts)


def test_long_words_and_pieces(monkeypatch):
    text = " ".join(["k" * 200, "l" * 3, "m", "n o p"] * 20)
    whole = shingles.shingle_sets(pa.array([text, "a b c d", text]), 4)
    monkeypatch.setattr(shingles, "PIECE", 64)
    monkeypatch.setattr(shingles, "_powers", {})
    pieces = shingles.shingle_sets(pa.array([text, "a b c d", text]), 4)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))


@pytest.mark.parametrize(("name", "label", "mod", "held"), [("op1_toxicity", "toxic", 5, 0), ("op6_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, label, mod, held):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    docs = spark.read.parquet(sf + "/documents.parquet")
    assert len(got) == docs.count()
    right = []
    for r in spark.read.parquet(sf + "/labels.parquet").collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        if x.held_out:
            right.append(x.predicted == r[label])
    assert np.mean(right) > 0.9


def test_scores_of_awkward_tables(spark):
    texts = [None, "", "fine words here", "IDIOT idiot", "!!! ??? ...", "x" * 100_000, "fine words here"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)] + [(None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for fitted in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.limit(0)), toxicity.fit(docs.limit(0), labels)):
        out = {r.doc_id: r.score for r in toxicity.score_documents(docs, fitted).collect()}
        assert len(out) == 7 and all(0 <= s <= 1 for s in out.values()) and out[2] == out[6]
        assert toxicity.score_documents(docs.limit(0), fitted).count() == 0
    for net in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0))):
        out = {r.doc_id: r.score for r in quality.score_documents(docs, net).collect()}
        assert len(out) == 7 and all(0 <= s <= 1 for s in out.values()) and out[2] == out[6]


def test_scores_do_not_depend_on_the_batch(spark):
    """Equal texts get equal scores to the last bit, alone or beside any others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(120)
    net = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = [r.text for r in docs.collect()] + ["", None, "é" * 5000]
    together = net.score(pa.array(texts))
    assert [net.score(pa.array([t], pa.string()))[0] for t in texts] == together.tolist()
    assert net.score(pa.array(texts[::-1]))[::-1].tolist() == together.tolist()


def test_a_repeated_id_is_fitted_on_once(spark):
    rows = [(i, f"text {i}", None) for i in range(20)]
    docs = spark.createDataFrame(rows + [(3, "text 3", None)] * 2000 + [(4, "other text", None)], "doc_id long, text string, `a.b` int")
    ids = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, y int")
    got = labelled.sample_rows(docs, ids).collect()
    assert sorted(r.id for r in got) == list(range(10)) and all(r.text == f"text {r.id}" or r.id == 4 for r in got)


def test_sample_is_bounded_and_leaves_the_held_out_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    ids = labelled.sample_ids(labels, "toxic", 5, 0, 50).collect()
    assert len(ids) == 50 and all(zlib.crc32(str(r.id).encode()) % 5 for r in ids)


def test_toxic_features_undo_obfuscation():
    odds = toxicity.Odds({"=idiot": 4.0, "idio-": 3.0})
    assert toxicity.features("you are an idiot", odds)[0] == 1
    assert toxicity.features("you are an 1d10t", odds)[7] == 1
    assert toxicity.features("what an i d i o t you are", odds)[7] == 1
    assert toxicity.features("what an i.d.i.o.t. here", odds)[7] == 1
    assert toxicity.features("plain words at 10.5 mail@host.org", odds)[7] == 0
    assert len(toxicity.features(None, odds)) == len(toxicity.features("a", odds))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body class="has-sidebar">
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="ad">Buy</div>
<article><header><h1>Title &amp;
 more</h1></header><p>One<br>two &#x41;&nbsp;<b>bo<i>ld</b> end<p>Three 1 < 2<ul><li>x<li>y</ul><div class="cookie-notice">We use cookies</div>
<table><tr><td>a<td>b<tr><td>c</table><aside>side</aside><form><p>mail<input></form><section id="comments"><article class="comment">hi</article></section><p>last</article>
<section class="comments"><p>reader</p></section><footer>foot</footer><p>tail"""


def page_text(html):
    return html_text.main_blocks(html_text.read_page(html)[0], set(), set())


def test_article_of_a_page():
    assert page_text(PAGE) == ["Title & more", "One two A bold end", "Three 1 < 2", "x", "y", "a b", "c", "last"]
    assert page_text("<main><p>a</main><p>b") == ["a"]
    assert page_text("plain &lt;text&gt; only") == ["plain <text> only"]
    assert page_text(None) == page_text("") == page_text("<")[1:] == page_text("<script>x") == page_text("<!-- a <p>b") == []
    assert page_text("<p>cut of<b") == ["cut of"]
    assert page_text('<p title="a>b">q</p><p title="open>r</p>') == ["q", "r"]
    assert page_text("<p hidden>no</p><p aria-hidden=true>no<p>yes") == ["yes"]


def test_long_pages_take_linear_time():
    for html in ("<p>word " * 100_000, "<" * 200_000, '<a "' * 50_000, "<b>" * 3000 + "x"):
        html_text.read_page(html)


def test_template_of_a_host(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=n))
    rows, want = [], {}
    for i in range(12):
        body = [text(20) + f" {i}", text(30) + f" {i}"]
        menu = "".join(f'<li><a href="/{k}">{text(1)}{k}</a></li>' for k in range(i % 3 + 3))
        rows.append((i, f"http://h.org/{i}", f"<div><p>Welcome to our site</p></div><div><ul>{menu}</ul></div><div><p>{body[0]}</p><p>{body[1]}</p></div>"
                     "<div><p>All of this is ours</p></div>"))
        want[i] = "\n\n".join(body)
    for i in range(12, 15):  # too few pages for a template, no host, no html
        rows.append((i, ["http://lone.org/", None, "http://h.org/none"][i - 12], ["<p>Welcome</p>", "<p>no host</p>", None][i - 12]))
        want[i] = ["Welcome", "no host", ""][i - 12]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS Text", "1 AS path")
    out = extraction.extract_text(df)
    assert out.columns == ["page_id", "url", "path", "text", "n_chars"]
    got = {x.page_id: x.text for x in out.collect()}
    assert got == want and out.count() == 16
    assert all(x.n_chars == len(x.text) for x in out.collect())
    assert extraction.extract_text(df.limit(0)).count() == 0


def test_salted_templates_give_the_same_text(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    broad = sorted(map(tuple, extraction.extract_text(pages).collect()))
    monkeypatch.setattr(extraction, "MOST_HOSTS", 0)
    assert sorted(map(tuple, extraction.extract_text(pages).collect())) == broad


def varied_pages(page, n=12):
    r = random.Random(2)
    words = lambda k: " ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=k))
    return [(i, f"http://h.org/{i}", page(i, words)) for i in range(n)]


def extracted(spark, rows):
    return {x.page_id: x.text for x in extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize(("outer", "teaser"), [('<div class="body">', '<article class="card">'), ('<div class="social-legal">', '<article class="related">'),
                                               ('<form>', '<article>')])
def test_template_prefers_the_body_to_a_teaser_article(spark, outer, teaser):
    want = {}

    def page(i, words):
        want[i] = f"{words(400)} {i}"
        end = outer.split()[0].strip("<>")
        return (f"<html><body><nav><a href='/'>Home</a></nav>{outer}<p>{want[i]}</p></{end}>{teaser}<p>{words(8)} {i}</p></article>"
                f"<footer>ours {i}</footer></body></html>")
    assert extracted(spark, varied_pages(page)) == want


def test_template_counts_tokens_inside_articles(spark):
    want = {}

    def page(i, words):
        body = [f"{words(40)} {i} {k}" for k in range(i % 3 + 2)]
        want[i] = "\n\n".join(["Title " + str(i), *body])
        return (f"<html><body><article><h1>Title {i}</h1>{''.join(f'<p>{b}</p>' for b in body)}<div class='tools'><p>Print this page</p></div>"
                f"<ul><li><a href='/a'>{words(3)}</a></ul></article></body></html>")
    assert extracted(spark, varied_pages(page)) == want


def test_copies_of_one_article_are_no_template(spark):
    html = "<html><body><div><p>One article on all pages of the host.</p><p>Its second paragraph.</p></div></body></html>"
    rows = [(i, f"http://mirror.org/a?utm={i}", html) for i in range(8)] + [(8, "http://mirror.org/a?utm=0", html)] * 2
    assert set(extracted(spark, rows).values()) == {"One article on all pages of the host.\n\nIts second paragraph."}
    # a page that is repeated whole counts once, also with enough others
    other = varied_pages(lambda i, words: f"<div><p>Welcome</p><p>{words(30)} {i}</p></div>")
    got = extracted(spark, other + [other[0]] * 3)
    assert all("Welcome" not in t and t.endswith(f" {i}") for i, t in got.items()) and len(got) == 12


def test_long_texts_need_evidence_to_be_the_template(spark):
    shared, notice, want = "A paragraph that all pages of the host share. " * 8, "We are closed on the days before and after the holiday. " * 8, {}

    def page(i, words):
        body = [f"{words(40)} {i} {k}" for k in range(i % 3 + 1)]
        want[i] = "\n\n".join([body[0], shared.strip(), *body[1:]])
        closed = f"<div class='hours'><p>{notice}</p></div>" if i % 4 else ""
        return f"<html><body>{closed}<div><p>{body[0]}</p><p>{shared}</p>{''.join(f'<p>{b}</p>' for b in body[1:])}</div></body></html>"
    assert extracted(spark, varied_pages(page)) == want
