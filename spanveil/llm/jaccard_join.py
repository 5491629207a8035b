"""Exact n-gram Jaccard self-join by token-combination prefixes.

Two texts link when the Jaccard similarity of their sets of word shingles reaches
a threshold t.  The join works on distinct sets ("nodes"), so copies cost
one row each, and returns connected components of the links:

1. *Sketch*.  A node's shingle hashes, sorted, are cut to the prefix of n - ceil(tn)
   + l hashes.  Two linked sets share at least l tokens of these prefixes (l of the
   smaller one), whatever the order of the hashes.
2. *Frequencies*.  Tokens of the sketches that no second row holds cannot be shared
   and are dropped; a node left with fewer than l tokens has no link.  This clears
   nearly all of an ordinary corpus after one count and one join on the token.
3. *Index*.  What is left of each sketch is ordered by (frequency, token).  Two linked
   nodes share their first two common tokens within the first |X| - l + 2: either
   one of these is rare (frequency up to ``RARE``), or both are frequent.  So
   rare tokens are indexed alone and frequent ones in combinations of two.  In sets
   of ``LONG`` shingles and more, where combinations grow with the square of the
   prefix, frequent tokens are indexed alone, too; sets around the limit do both.
4. *Verify*.  Round one verifies each node against the smallest node of each of its
   buckets; most buckets are one component after it.  Round two verifies every pair
   of a bucket that still lies in two components: small buckets as pairs; large
   ones chunk against chunk in numpy, only nodes outside the largest component of
   the bucket family against the others.  A pair's exact similarity is taken from the full
   sets, which are made again from the text for the nodes in buckets only.

No bucket, partner list or candidate list is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix64, shingle_sets, slices
from .util import col, cut_lineage, cut_measured, drop_tables, only_ids, sheltered

#: shingle length and similarity in percent
WORDS, PERCENT = 4, 85
#: a sketch token held by at most so many rows is indexed alone
RARE = 64
#: sets with at least so many shingles index frequent tokens alone
LONG = 1000
#: buckets up to this size are verified pair by pair, larger ones in chunks of CHUNK nodes, or more while they hold
#: CHUNK_TOKENS shingles: each set is sent once to every chunk of the other side
SMALL_BUCKET, CHUNK, CHUNK_TOKENS = 64, 256, 1 << 18

_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def least_size(n, percent: int):
    """ceil(t * n): the fewest shingles that a linked set shares with one of n."""
    return -(-n * percent // 100)


def extension(n, percent: int):
    """l: how many shared tokens the sketch of a set of n guarantees (a twentieth of it, 8 at least, all of a small one)."""
    return np.maximum(-(-n // 20), np.minimum(least_size(n, percent), 8))


def _extension_sql(n: str, percent: int) -> str:
    return f"greatest(({n} + 19) div 20, least(({n} * {percent} + 99) div 100, 8))"


def set_node(tokens: np.ndarray) -> int:
    """One 64-bit number for a set."""
    total = mix64(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix64(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _sketches(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            nodes, sizes, sketches = [], [], []
            for id_, tokens in zip(batch.column(0), shingle_sets(batch.column(1), words), strict=True):
                n = len(tokens)
                node = set_node(tokens)
                nodes.append(node)
                sizes.append(n)
                # a set that one more shingle takes below the threshold links with its copies only
                if 100 * n < percent * (n + 1) or node in seen or not id_.is_valid:
                    sketches.append(None)
                    continue
                seen.add(node)
                sketches.append(tokens[:n - least_size(n, percent) + int(extension(n, percent))].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()),
                                              pa.array(sketches, pa.list_(pa.int64()))], schema=_SKETCH)
    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            sets = [s for s in shingle_sets(batch.column(0), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_node(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()),
                                              pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=_SETS)
    return run


def sketch_table(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per document: doc_id, node (its set), n (set size), tokens (the sketch;
    null for a set already met in the same task or too small for any other link)."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col)).mapInArrow(
        _sketches(words, percent), "doc_id long, node long, n int, tokens array<long>")


def survivors(sketch: DataFrame, percent: int) -> DataFrame:
    """Nodes whose sketch holds enough shared tokens: node, n, need, x (structs df, tok; ascending)."""
    rows = sketch.filter("tokens IS NOT NULL").select("node", "n", F.explode("tokens").alias("tok"))
    shared = rows.groupBy("tok").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    nodes = rows.join(shared, "tok").groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "tok"))).alias("x"))
    # any partner has at least ceil(tn) shingles; the pair shares l of the smaller of the two
    need = _extension_sql(f"((n * {percent} + 99) div 100)", percent)
    return nodes.withColumn("need", F.expr(need).cast("int")).filter("size(x) >= need")


def signatures(nodes: DataFrame, percent: int, rare: int, long: int) -> DataFrame:
    """sig, node, n: rare tokens alone, frequent ones in twos (or alone in long sets)."""
    prefix = nodes.withColumn("p", F.expr("slice(x, 1, least(size(x), size(x) - need + 2))")).withColumns({
        "few": F.expr(f"transform(filter(p, t -> t.df <= {rare}), t -> xxhash64(1, t.tok))"),
        "many": F.expr(f"transform(filter(p, t -> t.df > {rare}), t -> t.tok)")})
    twos = F.expr("flatten(transform(many, (a, i) -> transform(slice(many, i + 2, size(many)), b -> xxhash64(2, a, b))))")
    ones = F.expr("transform(many, a -> xxhash64(1, a))")
    none = F.expr("cast(array() AS array<bigint>)")
    sigs = F.concat("few", F.when(F.expr(f"size(many) > 1 AND n * {percent} < {long} * 100"), twos).otherwise(none),
                    F.when(F.expr(f"n >= {long}"), ones).otherwise(none))
    return prefix.select(F.explode(sigs).alias("sig"), "node", "n")


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    x = nodes.select("node", "n", F.expr("transform(x, t -> t.tok)").alias("x"))
    both = pairs.join(x.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa")), "a").join(
        x.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb")), "b")
    near = both.filter(F.expr("size(array_intersect(xa, xb))") >= F.expr(_extension_sql("least(na, nb)", percent))).select("a", "b")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    return full.withColumn("i", F.expr("size(array_intersect(ta, tb))")).filter(
        f"100 * i >= {percent} * (na + nb - i)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _compatible(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _chunk_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of one chunk pair; one link per node of the left chunk and component of the right one is enough."""
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        out = []
        if len(left) and len(right):
            known, flat = np.unique(np.concatenate(right["tokens"].to_list()), return_inverse=True)
            at = np.concatenate(([0], np.cumsum(right["n"].to_numpy())))[:-1]
            sizes, comps, ids = right["n"].to_numpy(), right["comp"].to_numpy(), right["node"].to_numpy()
            for node, comp, n, tokens in zip(left["node"], left["comp"], left["n"], left["tokens"], strict=True):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                held = np.zeros(len(known), dtype=np.int64)
                held[place[known[place] == tokens]] = 1
                shared = np.add.reduceat(held[flat], at)
                hit = np.flatnonzero((comps != comp) & (100 * shared >= percent * (sizes + n - shared)))
                out += [(node, ids[hit[k]]) for k in np.unique(comps[hit], return_index=True)[1]]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _chunk_rows(members: DataFrame) -> DataFrame:
    """The nodes of families (root, node, n, comp), dealt out in pairs of chunks (root, i, j): side 0, outside the largest component
    of the family, against side 1, all of it."""
    def lots_of(rows: str, shingles: str) -> Column:
        return F.expr(f"cast(least(ceil(({rows}) / {CHUNK}), ceil(({shingles}) / {CHUNK_TOKENS})) AS int)")

    comps = members.groupBy("root", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    roots = comps.groupBy("root").agg(F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s"))
    sizes = roots.filter("all_c > m.c").select("root", F.col("m.comp").alias("main"), lots_of("all_c", "all_s").alias("chunks"),
                                               lots_of("all_c - m.c", "all_s - m.s").alias("parts"))
    # a node goes to its chunk of the right for each chunk of the left, and outside the largest component the other way round, too
    right = "transform(sequence(0, parts - 1), i -> struct(i AS i, cast(pmod(xxhash64(node), chunks) AS int) AS j, 1 AS side))"
    left = "transform(sequence(0, chunks - 1), j -> struct(cast(pmod(xxhash64(node), parts) AS int) AS i, j AS j, 0 AS side))"
    dealt = members.join(sizes, "root").select("root", "node", "comp", F.explode(F.expr(f"IF(comp <> main, concat({left}, {right}), {right})")).alias("e"))
    return dealt.select("root", "e.i", "e.j", "node", "comp", "e.side")


def _family_members(buckets: DataFrame) -> DataFrame:
    """root, node, n, comp: large buckets (sig, node, n, comp) that share nodes form one family, so that a pair is verified
    once, not once a bucket."""
    hub = buckets.groupBy("sig").agg(F.min("node").alias("hub"))
    family = components(buckets.join(hub, "sig").select(F.col("node").alias("u"), F.col("hub").alias("v")), "families")
    return cut_lineage(buckets.select("node", "n", "comp").distinct().join(family, "node"), "family-members")


def _large_bucket_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within the families of large buckets."""
    return _chunk_rows(members).join(sets, "node").groupBy("root", "i", "j").applyInPandas(_chunk_links(percent), "u long, v long")


def jaccard_links(docs: DataFrame, sketch: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT,
                  rare: int = RARE, long: int = LONG, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(node, root): the components of linked nodes, for nodes with a link to another node.  Its working tables are deleted when
    nothing reads them any more."""
    nodes = cut_lineage(survivors(sketch, percent), "jaccard-nodes")
    sigs = cut_lineage(signatures(nodes, percent, rare, long).distinct(), "jaccard-signatures")
    hubs = sigs.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("hub")).filter("c > 1")
    buckets = cut_lineage(sigs.join(hubs, "sig").select("sig", "node", "n", "c", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")),
                          "jaccard-buckets")
    drop_tables(sigs)

    # full sets of the nodes in buckets, made from one document of each
    wanted = buckets.select("node").distinct()
    ids = cut_lineage(sketch.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "jaccard-ids")
    sets = cut_lineage(only_ids(docs, ids, id_col).select(col(text_col)).mapInArrow(_full_sets(words), "node long, n int, tokens array<long>")
                       .join(wanted, "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")
    drop_tables(ids)

    stars = buckets.filter("node <> hub").filter(_compatible("n", "hub_n", percent)).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    stars = cut_lineage(stars, "jaccard-stars")
    links = cut_lineage(_linked(stars, nodes, sets, percent), "jaccard-links")

    roots = components(links, "jaccard-components")
    drop_tables(links)
    placed = buckets.select("sig", "node", "n", "c").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    split = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
    unsure, found = cut_measured(placed.join(split, "sig"), "jaccard-unsure", large=F.count_if(F.col("c") > small_bucket))
    drop_tables(buckets)
    if not found["rows"]:
        drop_tables(nodes, sets, stars, unsure)
        return roots
    few = unsure.filter(f"c <= {small_bucket}")
    pairs = few.alias("l").join(few.alias("r"), F.expr(
        f"l.sig = r.sig AND l.node < r.node AND l.comp <> r.comp AND {_compatible('l.n', 'r.n', percent)}")).select(
        F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    # each kind of links is written by itself: a plan of both would be planned anew, whole, after every stage of either
    written = [cut_measured(_linked(pairs, nodes, sets, percent), "jaccard-links")]
    if found["large"]:
        members = _family_members(unsure.filter(f"c > {small_bucket}"))
        written.append(cut_measured(_large_bucket_links(members, sets, percent), "jaccard-links"))
        drop_tables(members)
    drop_tables(nodes, sets, stars, unsure)
    more = [links for links, got in written if got["rows"]]
    if more:
        roots = components(reduce(DataFrame.unionByName, more, roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "jaccard-components")
    drop_tables(*(links for links, _ in written))
    return roots


def _labels(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, limits: dict) -> tuple[DataFrame, DataFrame]:
    """The sketch table, and (node, label): the smallest doc_id of the node's component."""
    sketch = cut_lineage(sketch_table(docs, id_col, text_col, words, percent), "jaccard-sketch")
    roots = jaccard_links(docs, sketch, id_col, text_col, words, percent, **limits)
    first = cut_lineage(sketch.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("own")), "jaccard-first")
    best = first.join(roots, "node").groupBy("root").agg(F.min("own").alias("best"))
    label = first.join(roots, "node", "left").join(best, "root", "left").select("node", F.coalesce("best", "own").alias("label"))
    return sketch, label


def _answer(sketch: DataFrame, label: DataFrame) -> DataFrame:
    return sketch.select("doc_id", "n", "node").join(label, "node", "left").withColumn(
        "component_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))).drop("label")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
                       **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id (long), n_shingles, component_id.

    A text's set are its distinct ``words``-word shingles, A-Z lower-cased; a shorter
    text is one shingle, a null, empty or blank one has none and links with
    nothing.  Two rows link when 100 * intersection >= ``percent`` * union; component_id
    is the smallest doc_id reachable by links, the row's own included.  Rows may
    repeat; rows with a null id link with nothing (component_id null).  Other columns are ignored.
    """
    return _answer(*_labels(docs, id_col, text_col, words, percent, limits)).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _with_nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            sets = shingle_sets(b.column(1), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(set_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32())],
                                             names=["kept", "node", "n"])
    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
                **limits) -> DataFrame:
    """``docs`` (its columns unchanged, whatever they are called) with one row of each component: that of the smallest id.

    Of rows that repeat an id and a shingle set one stays; an id with several texts stays with those that are not in a component
    of a smaller id.  Rows without words and rows with a null id all stay.  An empty table stays empty.
    """
    sketch, label = _labels(docs, id_col, text_col, words, percent, limits)
    answer = cut_lineage(_answer(sketch, label), "jaccard-answer")
    drop_tables(sketch)
    # ids that go, or come more than once: their rows are looked at one by one
    touched = answer.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"), F.max(F.expr("component_id <> doc_id")).alias("goes"))
    touched = cut_lineage(touched.filter("repeated OR goes"), "jaccard-touched")
    shelter, (key, text), back = sheltered(docs, id_col, text_col)
    once = only_ids(shelter, touched.select("doc_id"), key, "left_anti")
    names = shelter.columns
    many = only_ids(shelter, touched.filter("repeated").select("doc_id"), key).select(F.struct(*names).alias("kept"), F.col(text).alias("text"))
    schema = many.select("kept").withColumns({"node": F.lit(0).cast("long"), "n": F.lit(0)}).schema
    many = many.mapInArrow(_with_nodes(words), schema).withColumn("own", F.col(f"kept.{key}"))
    kept = answer.filter("component_id = doc_id").select("doc_id", F.col("node").alias("kept_node")).distinct()
    many = many.join(kept, F.expr("own = doc_id AND node = kept_node"))
    worded = many.filter("n > 0").dropDuplicates(["own", "node"])
    return back(once.unionByName(worded.unionByName(many.filter("n = 0")).select("kept.*")), [])
