"""License scan by sparse TF-IDF cosine, with inheritance along directories
(DataFrame functions only).

Statements (lines and sentences, and up to ``WINDOW`` of them together, so that headers may be wrapped) of a file are
compared with licence templates as sparse TF-IDF vectors: one row per term, joined on the term, summed to cosines; an SPDX tag
counts as it stands.  A file is a licence file if as a whole it is like a licence's text, or if a licence
statement makes up at least half of its words; it licenses its directory.  A file without a statement of its own takes the licence of the nearest
ancestor directory that has one: directories, not files, are joined with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .util import col, cut_lineage, small

#: fixed values: usual licence statements, by SPDX id where there is one
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("LicenseRef-all-rights-reserved", "All rights reserved"),
    ("MIT", "Licensed under the terms of the MIT license"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LicenseRef-GPL", "GNU General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("BSD-3-Clause", "Source code is governed by a BSD-style license found in the LICENSE file"),
]
#: statements that are compared together, at most
WINDOW = 5
#: an SPDX tag with its expression
SPDX = r"(?i)\bSPDX-License-Identifier:[ \t]*\(*([a-z0-9][a-z0-9.+-]*(?:[ \t()]+(?:AND|OR|WITH)[ \t(]+[a-z0-9][a-z0-9.+-]*)*)"
#: every licence's text has one of these; files without are not compared as a whole
ANCHORS = r"(?i)licen[cs]e|copyright|warrant"
#: least cosine of a statement
LEAST_COSINE = 0.75
#: looked for last, being in every other sentence
COMMON = frozenset("the this is under into to and in or of a any with without are be by you may not use file work source all terms free person copy forms that it was can be one at if as either found its my your later except code 2 3 program form published".split())
#: of these the last
EVERYWHERE = frozenset("the this that with into to and in or of a any it was be by you may not can one at if as are all".split())
TERM = r"[\p{L}0-9]+(?:[.-][\p{L}0-9]+)*"
_TERM = re.compile(TERM.replace(r"\p{L}", "a-zA-Z"))
#: resolved directories of at most so many rows are broadcast
MOST_DIRECTORIES = 200_000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_vectors(templates=TEMPLATES) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """idf by term, the idf of any other term, and rows (template, license, term, weight / norm)."""
    terms = [Counter(_TERM.findall(t.lower())) for _, t in templates]
    df = Counter(w for t in terms for w in t)
    idf = {w: math.log((1 + len(terms)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for i, (t, (name, _)) in enumerate(zip(terms, templates, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items()))
        rows += [(i, name, w, n * idf[w] / norm) for w, n in t.items()]
    return idf, math.log(1 + len(terms)) + 1, rows


def text_vectors(texts=TEXTS) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """As ``template_vectors``, of whole texts, without the common words; a word's count counts by 1 + ln."""
    terms = [{w: int(n or 1) for w, _, n in (x.partition(":") for x in t.split()) if w not in COMMON} for _, t in texts]
    df = Counter(w for t in terms for w in t)
    idf = {w: math.log((1 + len(terms)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for i, (t, (name, _)) in enumerate(zip(terms, texts, strict=True)):
        weights = {w: (1 + math.log(n)) * idf[w] for w, n in t.items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        rows += [(i, name, w, v / norm) for w, v in weights.items()]
    return idf, math.log(1 + len(terms)) + 1, rows


def whole_texts(files: DataFrame, texts=TEXTS) -> DataFrame:
    """file, license, cosine: the licence whose text a file is, where its cosine reaches ``LEAST_COSINE``.  ``files``: file, text."""
    spark: SparkSession = files.sparkSession
    idf, other, rows = text_vectors(texts)
    tf = files.filter(F.col("text").rlike(ANCHORS)).select("file", F.explode(F.filter(
        F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), 0), lambda x: ~x.isin(*sorted(COMMON)))).alias("term")).groupBy("file", "term").agg(
        F.count("*").alias("tf"))
    idfs = F.broadcast(spark.createDataFrame([(w, v) for w, v in idf.items()], "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double"))
    weighed = cut_lineage(tf.join(idfs, "term", "left").select("file", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).alias("w")), "license-words")
    norms = weighed.groupBy("file").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy("file", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "file").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= LEAST_COSINE)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template", "license")).alias("b"))
    return best.select("file", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def telling_terms(rows: list[tuple[int, str, str, float]]) -> list[str]:
    """Terms of which a statement that reaches the cosine with any template holds one: of each template the longest (most telling)
    terms, until what is left of its vector is shorter than the least cosine."""
    out = set()
    for i in {r[0] for r in rows}:
        left = 1.0
        for _, _, _, term, weight in sorted(((w not in COMMON, w not in EVERYWHERE, len(w), w, v) for t, _, w, v in rows if t == i), reverse=True):
            if left < LEAST_COSINE ** 2 - 1e-9:
                break
            out.add(term)
            left -= weight * weight
    return sorted(out)


def statements(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """file, n (its words), part, words (of the statement), license, cosine: the best template of every
    statement whose cosine reaches ``LEAST_COSINE``.  ``files``: file, text."""
    spark: SparkSession = files.sparkSession
    idf, other, rows = template_vectors(templates)
    # look for these terms before taking words apart
    some = f"(?i)\\b(?:spdx-license-identifier|{'|'.join(map(re.escape, telling_terms(rows)))})\\b"
    holding = files.filter(F.col("text").rlike(some))
    lines = holding.select("file", F.regexp_count("text", F.lit(TERM)).alias("n"), F.split("text", r"[\n\r]+|(?<=[.!?;])[ \t]+").alias("s"))
    # the windows around every line that holds one of the terms, of one line and more
    hits = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.get("s", i).rlike(some))
    starts = lines.select("file", "n", "s", F.explode(F.array_distinct(F.flatten(F.transform(
        hits, lambda i: F.sequence(F.greatest(F.lit(0), i - (WINDOW - 1)), i))))).alias("start"))
    lower = F.transform(F.slice("s", F.col("start") + 1, WINDOW), lambda x: F.regexp_extract_all(_lower(x), F.lit(TERM), 0))
    near = starts.select("file", "n", "start", F.get("s", F.col("start")).alias("s"), lower.alias("w"))
    parts = near.select("file", "n", "start", "s", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k")).select(
        "file", "n", ((F.col("start") + 1) * WINDOW - F.col("k")).alias("part"), "s", "k", F.flatten(F.slice("w", F.lit(1), F.col("k"))).alias("terms"))
    tags = parts.filter("k = 1").withColumn("license", F.regexp_extract("s", SPDX, 1)).filter("license <> ''").select(
        "file", "n", "part", F.size("terms").cast("long").alias("words"), "license", F.lit(1.0).alias("cosine"))
    # a cosine c needs c^2 of the squared length on the templates' terms: no more than the square of their count, while each other term, of
    # the largest idf, adds one at least
    known = F.size(F.filter("terms", lambda x: x.isin(*sorted(idf))))
    unknown = F.size(F.filter(F.array_distinct("terms"), lambda x: ~x.isin(*sorted(idf))))
    able = parts.filter(known * known * (1 - LEAST_COSINE ** 2) >= unknown * LEAST_COSINE ** 2)
    tf = able.select("file", "n", "part", F.explode("terms").alias("term")).groupBy("file", "n", "part", "term").agg(F.count("*").alias("tf"))
    idfs = F.broadcast(spark.createDataFrame([(w, v) for w, v in idf.items()], "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, weight double"))
    weighed = cut_lineage(tf.join(idfs, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))).drop("idf"), "license-terms")
    norms = weighed.groupBy("file", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = weighed.join(vectors, "term").groupBy("file", "n", "part", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["file", "part"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= LEAST_COSINE)
    best = scored.groupBy("file", "n", "part", "words").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template", "license")).alias("b"))
    return best.select("file", "n", "part", "words", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")).unionAll(tags)


def directory(path: Column) -> Column:
    """All before the last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, path, license, found ('header', 'file', 'inherited', or null with a null license),
    licensed_by (the directory it is inherited from), cosine (of an own statement).

    A file that is a licence's text has that licence.  Else, of a file's statements the one of largest cosine counts, then the first, then the longest.  Of a directory's licence files the one of
    largest cosine counts, then the smallest path.  A file with a statement of its own inherits nothing.  Null texts hold no statement; a null path
    has no directory.  Rows that repeat id and path are one file each and get the same answer; other columns are ignored.
    """
    keyed = files.select(col(id_col).alias("id"), col(path_col).alias("path"), col(text_col).alias("text"))
    keyed = keyed.withColumn("file", F.struct("id", "path"))
    own = statements(keyed.select("file", "text"), templates)
    own = own.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "part", "license", "words", "n")).alias("b")).select(
        F.col("file.id").alias("id"), F.col("file.path").alias("path"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"),
        F.expr("2 * b.words >= b.n").alias("whole"))
    texts = whole_texts(keyed.select("file", "text").filter("text IS NOT NULL")).select(
        F.col("file.id").alias("id"), F.col("file.path").alias("path"), "license", "cosine", F.lit(True).alias("whole"))
    texts = cut_lineage(texts, "license-texts")
    own = cut_lineage(own, "license-own")
    own = own.alias("o").join(small(texts.alias("t"), MOST_DIRECTORIES), F.expr("o.id <=> t.id AND o.path <=> t.path"), "left_anti").unionAll(texts)
    own = cut_lineage(own, "license-statements")
    of_dir = own.filter("whole AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("dir")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("b")).select("dir", F.col("b.license").alias("license"))

    # every directory and its ancestors, itself first; the nearest with a licence
    names = keyed.filter("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    up = ("transform(sequence(size(split(dir, '/')), 0, -1), "
          "i -> struct(i AS depth, array_join(slice(split(dir, '/'), 1, i), '/') AS up))")
    above = names.select("dir", F.explode(F.expr(up)).alias("a")).select("dir", "a.depth", "a.up").filter("depth > 0 OR dir <> ''")
    nearest = above.join(of_dir.select(F.col("dir").alias("up"), "license"), "up").groupBy("dir").agg(
        F.max(F.struct("depth", "up", "license")).alias("b")).select(F.col("dir").alias("_dir"), F.col("b.up").alias("_up"), F.col("b.license").alias("_license"))
    nearest = cut_lineage(nearest, "license-directories")
    out = keyed.select("id", "path").alias("f").join(small(own.alias("o"), MOST_DIRECTORIES), F.expr("f.id <=> o.id AND f.path <=> o.path"), "left").select(
        "f.id", "f.path", "license", "cosine", "whole", directory(F.col("f.path")).alias("dir"))
    out = out.join(small(nearest, MOST_DIRECTORIES), F.expr("dir = _dir"), "left")
    inherits = F.col("license").isNull() & F.col("_license").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "_license").alias("license"),
        F.when(F.col("license").isNotNull(), F.when(F.col("whole"), "file").otherwise("header")).when(inherits, "inherited").alias("found"),
        F.when(inherits, F.col("_up")).alias("licensed_by"), "cosine")
