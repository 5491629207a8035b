"""Sharding, mixing, URL rules and licenses."""

import math
import random
import zlib
from collections import defaultdict

import pytest

from spanveil.llm import license_texts, licenses, mixing, sharding, url_rules

from . import brute

DOCS = "doc_id long, text string, source string"


def documents(n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "été", "x"], k=r.choice([0, 1, 5, 40, 300]))), r.choice(["a", "b", "é", "c", None, "hot", "hot", "hot"]))
            for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (5, rows[5][1], rows[5][2]), (None, "null id", "z"), (n + 2, None, "only empty")]


@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_shards(spark, n_shards):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "Shard")
    out = sharding.shard_by_bytes(df, n_shards).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    total, most = sum(size(t) for _, t, _ in rows), max(size(t) for _, t, _ in rows)
    by = defaultdict(list)
    for x in out:
        assert x["size"] == size(x["text"]) and x["text_crc32"] == zlib.crc32((x["text"] or "").encode()) and x["law"] == "bytes"
        by[x["shard"]].append(x)
    for s in range(n_shards):
        assert abs(sum(x["size"] for x in by[s]) - total / n_shards) <= most + 1
        assert sorted(x["slot"] for x in by[s]) == list(range(len(by[s])))
    # copies are neighbours: a text lies in shards next to each other
    where = defaultdict(set)
    for x in out:
        where[x["text"] or ""].add(x["shard"])
    assert all(max(s) - min(s) + 1 == len(s) for s in where.values())


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def water_level(sizes, weights, most=3):
    """Reshare what is above the limit by weight until none is above."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        if not free:
            return target
        left = total - sum(most * sizes[i] for i in capped)
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = float(most * sizes[i])
            capped.add(i)


def test_mix(spark):
    rows = documents()
    out = mixing.mix(spark.createDataFrame(rows, DOCS), blocks=16).collect()
    assert len(out) == len(rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len(brute.words(t)) for _, t, s in rows if s == n) for n in names]
    targets = dict(zip(names, water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken, most = defaultdict(int), defaultdict(int)
    for x in out:
        assert x["size"] == len(brute.words(x["text"])) and x["taken"] == x["copies"] * x["size"] <= 3 * x["size"]
        assert x["source_size"] == sizes[names.index(x["source"])]
        assert math.isclose(x["target"], targets[x["source"]], rel_tol=1e-12)
        taken[x["source"]] += x["taken"]
        most[x["source"]] = max(most[x["source"]], x["size"])
    for n in names:
        # the repeated row shares its key, so its two copies may both lie across the cut
        assert abs(taken[n] - targets[n]) <= 2 * most[n]
        copies = {x["copies"] for x in out if x["source"] == n}
        assert max(copies) - min(copies) <= 1  # whole epochs first
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()
    key = lambda x: (repr(x["doc_id"]), repr(x["text"]), x["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    repeated = mixing.repeat_rows(mixing.mix(spark.createDataFrame(rows, DOCS)), ["doc_id", "text", "source"])
    assert repeated.count() == sum(x["copies"] for x in out) and repeated.columns == ["doc_id", "text", "source"]


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_prefers_quality(spark):
    rows = [(i, "good words here " * 3 if i % 2 else "%%% $$$ ### &&& *** !!! +++ === ~~~", s) for i in range(600) for s in ("a", "b", "c")]
    rows = [(3 * i + "abc".index(s), t, s) for i, t, s in rows]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).filter("source = 'c'").collect()
    good = [x["copies"] for x in out if x["text"].startswith("good")]
    bad = [x["copies"] for x in out if not x["text"].startswith("good")]
    assert sum(good) / len(good) > 2 * sum(bad) / len(bad)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "", "/tmp"),
         ("block", "a-b.net", ""), ("allow", "b.net", "/x"), ("allow", "dup.org", "/"), ("block", "dup.org", "/"), ("allow", "example.com", "/en/ok/deep")]


def judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].encode().translate(brute._LOWER).decode(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_url_rules(spark):
    r = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "m.www.example.com", "xexample.com", "a.net", "a-b.net", "q.a-b.net", "b.net", "dup.org", "", "EXAMPLE.com",
             "example.com.", "a..net", "net", "x.y.z"]
    paths = ["", "/", "/en/", "/en/1", "/en/ok/deep/er", "/es/", "/es", "/tmp/1", "/x?y=/en/", "?q", "#/es/", "/x#y", "/é/en/"]
    urls = ["http://" + r.choice(hosts) + r.choice(paths) for _ in range(1500)] + [None, "", "no scheme", "x://", "://", "http://com/://net/es/", "a\nb://net/es/1"]
    urls += ["http://example.com/en/1"] * 500
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge_urls(df, url_rules.rules_table(spark, RULES)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(df.limit(0), url_rules.rules_table(spark, RULES)).count() == 0
    assert {x.verdict for x in url_rules.judge_urls(df.limit(9), url_rules.rules_table(spark, [])).collect()} == {"allow"}


def test_licenses(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [(1, "a/LICENSE", apache), (2, "a/b/c.txt", "plain words"), (3, "a/b/d.txt", "Some code here and more of it\n" + mit + "\nand so on for a while yet"),
            (4, "x/y.txt", "nothing"), (5, "a/b/e/LICENSE", "Licensed under CC BY-NC 4.0."), (6, "a/b/e/f/g.txt", None), (7, None, mit), (8, "top.txt", "license of thought"),
            (9, "a/z.txt", "the this is under the this"), (2, "a/b/c.txt", "plain words"), (None, "a/q.txt", ""), (10, "ab/c.txt", "x")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'x' AS license", "1 AS dir")
    got = [(x.doc_id, x.path, x.license, x.found, x.licensed_by) for x in licenses.scan_licenses(df).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a/LICENSE", "Apache-2.0", "file", None), (2, "a/b/c.txt", "Apache-2.0", "inherited", "a"), (2, "a/b/c.txt", "Apache-2.0", "inherited", "a"),
        (3, "a/b/d.txt", "MIT", "header", None), (4, "x/y.txt", None, None, None), (5, "a/b/e/LICENSE", "CC-BY-NC-4.0", "file", None),
        (6, "a/b/e/f/g.txt", "CC-BY-NC-4.0", "inherited", "a/b/e"), (7, None, "MIT", "file", None), (8, "top.txt", None, None, None),
        (9, "a/z.txt", "Apache-2.0", "inherited", "a"), (None, "a/q.txt", "Apache-2.0", "inherited", "a"), (10, "ab/c.txt", None, None, None)], key=repr)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_cosine_by_hand():
    idf, other, rows = licenses.template_vectors()
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        tf = licenses.Counter(licenses._TERM.findall(text.lower()))
        mine = {w: v for t, _, w, v in rows if t == i}
        assert math.isclose(sum(v * v for v in mine.values()), 1)
        # no template can be reached without a term that is looked for
        assert sum(v * v for w, v in mine.items() if w not in licenses.telling_terms(rows)) < licenses.LEAST_COSINE ** 2, text
        assert set(mine) == set(tf) and other >= max(idf.values())


def counted(name):
    """A text with the words of a licence's text as often as they stand there, in lines of ten."""
    words = [w for x in dict(license_texts.TEXTS)[name].split() for w, _, n in [x.partition(":")] for _ in range(int(n or 1))]
    random.Random(3).shuffle(words)
    return "\n".join(" ".join(words[i:i + 10]) for i in range(0, len(words), 10))


MIT_TEXT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_whole_licence_texts_license_their_directory(spark):
    names = [n for n, _ in license_texts.TEXTS]
    prose = "The copyright of this story is with its teller, who went to the market and bought bread for the way. " * 30
    rows = [(0, "m/LICENSE", MIT_TEXT), (1, "m/src/a.c", "int a;"), (2, "p/story.txt", prose), (3, "p/b.c", "int b;")]
    rows += [(10 + i, f"{n}/LICENSE", counted(n)) for i, n in enumerate(names)] + [(100 + i, f"{n}/x/y.c", "int x;") for i, n in enumerate(names)]
    got = {x.doc_id: (x.license, x.found, x.licensed_by) for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {0: ("MIT", "file", None), 1: ("MIT", "inherited", "m"), 2: (None, None, None), 3: (None, None, None)}
    want |= {10 + i: (n, "file", None) for i, n in enumerate(names)} | {100 + i: (n, "inherited", n) for i, n in enumerate(names)}
    assert got == want


@pytest.mark.parametrize(("license", "header"), [
    ("GPL-3.0", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
                " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
                " * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("LicenseRef-GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0 OR MIT", "# SPDX-License-Identifier: (Apache-2.0 OR MIT)"),
    ("MIT", "licensed under the terms of the MIT license")])
def test_usual_headers(spark, license, header):
    text = "first line of code\n" + header + "\n" + "code that goes on for a while yet\n" * 20
    x, = licenses.scan_licenses(spark.createDataFrame([(1, "a/b.c", text)], "doc_id long, path string, text string")).collect()
    assert (x.license, x.found) == (license, "header")
