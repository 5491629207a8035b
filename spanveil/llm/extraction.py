"""Main text of web pages by equivalence classes over the pages of a host.

Tokens of a page are its element paths and its texts in their places, inside article elements as elsewhere.  Tokens that
occur equally often on every page of the host share an occurrence vector and form an equivalence class.  Vectors are
compared by an additive fingerprint, so they are built by plain aggregation: no
page meets another, however many a host has.  Pages of equal text are one page of evidence.  Classes that are frequent
(on most pages of the host) and hold elements are valid; their element paths, nested by
path, are the host's template, and its sections are slots.  A slot holds the text whose nearest section it is.

Slots are ranked by the characters a page that are neither links nor on most pages.  The markup is evidence: article and
main elements raise a slot, marks (menu, footer, advert and the like) lower it.  The first slot, all that come near it and
the unmarked ones of its kind (in an article, in main, elsewhere) are the text, but for slots of mostly links.

Texts on most pages are the template's own words if they share their vector with the element they stand in (its place holds nothing
else), if they are mostly links, if their slot holds little else, or
if they are short and in no article or main element: a long text among changing ones is the article's.

A host with fewer than ``LEAST_PAGES`` different pages has no template; its pages are read by their markup alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_text import SECTIONS, by_markup, kind, main_blocks, read_page, slot_of
from .shingles import mix64
from .util import col, cut_lineage, only_ids, sheltered, small

#: different pages of a host, and the share of them that a valid class must cover
LEAST_PAGES, LEAST_SHARE = 4, 0.6
#: a slot with such a share of its characters in links is a menu
LINK_SHARE = 0.6
#: a text on most pages is short up to so many characters; a slot is fixed with at most such a share of other text
SHORT, CHANGING_SHARE = 200, 0.1
#: what article elements, main elements, neither and marks make of a slot's characters; a slot with such a share of the best is text
KIND_WEIGHT, MARK_WEIGHT, NEAR = (2.0, 1.5, 1.0), 0.1, 0.5
#: templates of at most so many hosts are broadcast; more are joined by host and ``SALTS`` parts of its pages
MOST_HOSTS, SALTS = 5000, 32

ADDED = ["text", "n_chars"]

#: characters, linked ones and marks times characters, by kind; an element's hold for all that is in it
_MASS = [f"{m}{k}" for k in range(3) for m in ("chars", "linked", "marks")]
_TOKENS = "host string, path string, words string, vector long, weight long, pages long, " + ", ".join(f"{m} long" for m in _MASS)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page a fingerprint of its text by markup, or of all its text where that is empty."""
    for batch in batches:
        hosts, keys, pages = (c.to_pylist() for c in batch.columns)
        prints = []
        for html in pages:
            blocks = read_page(html)[0]
            text = "\n".join(by_markup(blocks, set()) or [b.text for b in blocks])
            prints.append(int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(prints, pa.int64())],
                                         names=["host", "key", "content"])


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and host, the tokens' share of their occurrence vectors."""
    for batch in batches:
        total: dict[tuple, list[int]] = {}
        for host, key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks, paths = read_page(html)
            mass: dict[str, list[int]] = {}
            texts: dict[tuple, list[int]] = {}
            for b in blocks:
                at, n = 3 * kind(b.article, b.main), len(b.text)
                for m in (mass.setdefault(b.path, [0] * 9), texts.setdefault((b.path, b.text), [0] * 10)):
                    m[at] += n
                    m[at + 1] += min(b.linked, n)
                    m[at + 2] += b.marks * n
                texts[(b.path, b.text)][9] += 1
            within = {p: [0] * 9 for p in paths}
            for path, m in mass.items():
                while path:
                    if path in within:
                        within[path] = [x + y for x, y in zip(within[path], m, strict=True)]
                    path = path.rpartition("/")[0]
            tokens = [(p, None, n, within[p]) for p, n in paths.items()] + [(p, t, m[9], m[:9]) for (p, t), m in texts.items()]
            prints = mix64(np.array([n for _, _, n, _ in tokens], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                           + np.array([key], dtype=np.int64).view(np.uint64)).view(np.int64).tolist() if tokens else []
            for (path, words, _, m), v in zip(tokens, prints, strict=True):
                t = total.setdefault((host, path, words), [0] * 12)
                t[0] ^= v
                t[1] += v & 0xFFFFFF
                t[2] += 1
                for i, x in enumerate(m, 3):
                    if x:
                        t[i] += x
        keys, sums = list(total), list(total.values())
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([s[i] for s in sums], pa.int64()) for i in range(12)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "words", "vector", "weight", "pages", *_MASS])


def choose(elements: list[tuple[str, list[int]]], texts: list[tuple[str, str, list[int]]], settled: set = frozenset()) -> tuple[set, dict]:
    """The template's own texts (path, words), and by slot the marks up to which blocks of each kind are text (-1 for none).

    ``elements``: paths of valid classes with the mass in them; ``texts``: texts on most pages with their path and mass;
    ``settled``: those of them (path, words) in the class of the element they stand in."""
    own = {p: list(m) for p, m in elements if p.rpartition("/")[2].partition(".")[0] in SECTIONS}
    if not own:
        return set(), {}
    for p, m in elements:
        around = slot_of(p.rpartition("/")[0], own) if p in own else None
        if around is not None:
            own[around] = [x - y for x, y in zip(own[around], m, strict=True)]
    fixed = {p: [0] * 9 for p in own}
    placed = [(p, words, m, slot_of(p, own)) for p, words, m in texts]
    for _, _, m, at in placed:
        if at is not None:
            fixed[at] = [x + y for x, y in zip(fixed[at], m, strict=True)]
    score, base, menus = {}, {}, set()
    for p, m in own.items():
        for k in range(3):
            chars, linked, marks = m[3 * k:3 * k + 3]
            if chars <= 0:
                continue
            base[p, k] = round(marks / chars)
            changing = chars - fixed[p][3 * k] - (linked - fixed[p][3 * k + 1])
            score[p, k] = max(0, changing) * (MARK_WEIGHT if base[p, k] else KIND_WEIGHT[k])
            if linked >= LINK_SHARE * chars:
                menus.add((p, k))
    best = max(score, key=lambda s: (score[s], s), default=None)
    if best is None or not score[best]:
        best = None
    slots = {}
    for p in own:
        slots[p] = [-1, -1, -1]
        for k in range(3):
            if best is None or (p, k) in menus and (p, k) != best:
                continue
            level, near = base.get((p, k), 0), score.get((p, k), 0) >= NEAR * score[best]
            if level == 0 and (near or k == best[1] and (not base[best] or p.startswith(best[0] + "/"))):
                slots[p][k] = 0
            elif level and (near or k == best[1] and level == base[best] and p.startswith(best[0] + "/")):
                slots[p][k] = level
    drop = set()
    for p, words, m, at in placed:
        chars, linked, inside = m[0] + m[3] + m[6], m[1] + m[4] + m[7], m[0] + m[3]
        k = max(range(3), key=lambda k: m[3 * k])
        alone = at is not None and own[at][3 * k] - fixed[at][3 * k] <= CHANGING_SHARE * own[at][3 * k]
        if (p, words) in settled or linked >= LINK_SHARE * chars or alone or len(words) <= SHORT and not inside:
            drop.add((p, words))
    return drop, slots


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fixed, slots = [], []
        for row in batch.column(1).to_pylist():
            mass = [(t["path"], t["words"], [t[m] for m in _MASS]) for t in row]
            vectors = {(t["path"], t["words"]): (t["vector"], t["weight"], t["pages"]) for t in row}
            settled = {(p, w) for (p, w), v in vectors.items() if w is not None and vectors.get((p, None)) == v}
            drop, found = choose([(p, m) for p, w, m in mass if w is None], [t for t in mass if t[1] is not None], settled)
            fixed.append([{"path": p, "words": w} for p, w in sorted(drop)])
            slots.append([{"path": p, "marks": k} for p, k in sorted(found.items())])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(fixed, pa.list_(pa.struct([("path", pa.string()), ("words", pa.string())]))),
            pa.array(slots, pa.list_(pa.struct([("path", pa.string()), ("marks", pa.list_(pa.int32()))])))], names=["host", "fixed", "slots"])


def different_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One of the pages of equal text of every host, and (host, n): their number where there are ``LEAST_PAGES`` at least.

    Only keys are grouped; html is moved for rows that are repeated whole, one copy a task."""
    pages = pages.filter("host <> ''")
    by_key = cut_lineage(pages.select("host", "key", "html").mapInArrow(_contents, "host string, key long, content long").groupBy(
        "host", "content", "key").agg(F.count("*").alias("c")), "page-contents")
    firsts = cut_lineage(by_key.groupBy("host", "content").agg(F.min(F.struct("key", "c")).alias("f")).select("host", "f.key", "f.c"), "page-firsts")
    size = firsts.groupBy("host").agg(F.count("*").alias("n")).filter(f"n >= {LEAST_PAGES}")
    others = by_key.select("key").join(firsts.filter("c = 1").select("key"), "key", "left_anti")
    single = only_ids(pages, others, "key", "left_anti")
    repeated = only_ids(pages, firsts.filter("c > 1").select("key"), "key").groupBy("host", "key").agg(F.any_value("html").alias("html"))
    return single.select("host", "key", "html").unionAll(repeated.select("host", "key", "html")), size


def templates(pages: DataFrame) -> DataFrame:
    """One row per host with a template: host, fixed (array of path and words), slots (array of path and marks).

    ``pages``: host, key (a number for the page), html.  Both lists hold tokens on most of the host's
    pages only, so they are no longer than one page.
    """
    different, size = different_pages(pages)
    tokens = different.mapInArrow(_count_tokens, _TOKENS).groupBy("host", "path", "words").agg(
        F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("weight", "pages", *_MASS)])
    frequent = cut_lineage(tokens.join(small(size), "host").filter(f"pages >= {LEAST_SHARE} * n"), "template-tokens")
    return frequent.groupBy("host").agg(F.collect_list(F.struct("path", "words", "vector", "weight", "pages", *_MASS)).alias("tokens")).mapInArrow(
        _choose, "host string, fixed array<struct<path string, words string>>, slots array<struct<path string, marks array<int>>>")


def _extract(n_kept: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set, dict]] = {}
        for batch in batches:
            out = []
            hosts, html, fixed, slots = (batch.column(i) for i in range(n_kept, n_kept + 4))
            for i, (host, page) in enumerate(zip(hosts.to_pylist(), html.to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = ({(t["path"], t["words"]) for t in fixed[i].as_py() or ()}, {t["path"]: t["marks"] for t in slots[i].as_py() or ()})
                out.append("\n\n".join(main_blocks(read_page(page)[0], *known[host])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                                             names=names)
    return run


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with text (the article; blocks in page order joined by
    two line feeds, white space inside a block one space; empty if none) and n_chars (its code points).

    Null html and pages without an article give an empty text; a null URL has no host, so no template.
    Rows may repeat.  Input columns named like a result column (in any case) are replaced.
    """
    shelter, names, back = sheltered(pages, url_col, html_col)
    return back(_extract_text(shelter, *names), ADDED)


def _extract_text(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``extract_text`` of a table whose columns are called c0, c1, ..."""
    keyed = pages.select(col(html_col).alias("html"), host_of(col(url_col)).alias("host"), F.xxhash64(*map(col, pages.columns)).alias("key"))
    found = cut_lineage(templates(keyed), "templates").filter("size(slots) > 0")
    names = [c for c in pages.columns if c.lower() not in (*ADDED, html_col.lower())]
    rows = pages.select(*map(col, names), host_of(col(url_col)).alias("_host"), col(html_col).alias("_html"),
                        F.pmod(F.xxhash64(*map(col, pages.columns)), F.lit(SALTS)).alias("_salt"))
    template = found.select(F.col("host").alias("_thost"), "fixed", "slots")
    if found.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS:
        joined = rows.join(F.broadcast(template), F.expr("_host = _thost"), "left")
    else:
        salted = template.withColumn("_tsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, F.expr("_host = _thost AND _salt = _tsalt"), "left")
    schema = rows.select(*map(col, names)).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return joined.select(*map(col, names), "_host", "_html", "fixed", "slots").mapInArrow(_extract(len(names), schema.names), schema)
