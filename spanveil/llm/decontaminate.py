"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A benchmark item of m words is looked for in windows of m words of the documents.

1. *Windows.*  A window that holds no shingle of an item has similarity 0 to it,
   so windows are laid where a document's shingle falls on a shingle of an item: at
   the position that brings the two into line.  A passage with words put in, left out or
   changed has its lines on either side of the change, and a window for each.
2. *SimHash.*  A window's fingerprint has 64 bits, each the sign of the sum over its
   shingles of the bit as +1 or -1, weighted by count; an item's likewise.
3. *Multi-index.*  Fingerprints are cut into ``RADIUS`` + 1 blocks; two within
   ``RADIUS`` bits agree in at least one block, so one equi-join on (block,
   bits) finds all pairs within the radius.
4. *Verification.*  The exact weighted Jaccard similarity of the shingle
   counts, sum of minima over sum of maxima, must reach the threshold.

A shingle of the benchmark that very many documents hold costs one row for each
document and item that share it; nothing is compared document with document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import col, cut_lineage, small

#: words of a shingle, and the similarity in percent from which a window is a copy of an item
WORDS, PERCENT = 5, 80
#: fingerprints at most so many bits apart are candidates
RADIUS = 15
_BITS = 64
#: the window positions of at most so many documents are broadcast to their texts; of more, both are shuffled
MOST_STARTS = 200_000
_BLANK = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BLANK), "")


def shingle_hashes(words: str, k: int) -> Column:
    """The hashes of all k-word shingles of the array column ``words``, in order."""
    parts = ", ".join(f"v[i + {j}]" for j in range(k))
    # the array is bound to v once; named directly, it would be made again for each shingle
    return F.expr(f"transform(array({words}), v -> CASE WHEN size(v) >= {k} THEN transform(sequence(0, size(v) - {k}), "
                  f"i -> xxhash64({parts})) ELSE cast(array() AS array<bigint>) END)[0]")


def bit_sums(shingle: str, weight: str) -> list[str]:
    """Aggregates for the 64-bit SimHash of a group's shingles: how often each bit is set,
    two bits in one sum (31 bits each)."""
    sums = []
    for j in range(0, _BITS, 2):
        lanes = " | ".join(f"shiftleft(shiftrightunsigned({shingle}, {j + b}) & 1L, {31 * b})" for b in range(2))
        sums.append(f"sum(({lanes}) * {weight}) AS s{j}")
    return sums


def _bits_of_sums() -> str:
    bits = []
    for j in range(0, _BITS, 2):
        for b in range(2):
            bits.append(f"shiftleft(cast(2 * (shiftrightunsigned(s{j}, {31 * b}) & {(1 << 31) - 1}L) > total AS bigint), {j + b})")
    return " | ".join(bits)


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint, total (of c) of ``rows`` (keys, shingle, c), c the count of the shingle."""
    sums = rows.groupBy(*keys).agg(*[F.expr(s) for s in bit_sums("shingle", "c")], F.sum("c").alias("total"))
    return sums.select(*keys, F.expr(_bits_of_sums()).alias("fingerprint"), "total")


def blocks(df: DataFrame, radius: int) -> DataFrame:
    """``df`` with one row per block of its fingerprint: block (0 to radius) and bits."""
    n = radius + 1
    edges = [_BITS * i // n for i in range(n + 1)]
    parts = ", ".join(f"struct({i} AS block, shiftrightunsigned(fingerprint, {a}) & {(1 << (b - a)) - 1}L AS bits)"
                      for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    return df.withColumn("_b", F.explode(F.expr(f"array({parts})"))).select(*df.columns, "_b.block", "_b.bits")


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "shingle").agg(F.count("*").alias("c"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start (word position
    of the best window; the first of equals), n_words (of the item), similarity.

    Words are runs of other characters than white space, A-Z lower-cased.  Items of fewer than
    ``words`` words are compared by shingles of their own length; items without words, null or
    empty texts match nothing.  Rows that repeat an id are one document as to the result, each
    searched by itself; rows with a null id are ignored.  Other columns are ignored.
    """
    item = items.select(col(item_col).alias("item_id"), words_of(col(item_text)).alias("w")).filter(
        "item_id IS NOT NULL AND size(w) > 0").withColumn("m", F.size("w")).withColumn("k", F.least(F.col("m"), F.lit(words)))
    # an item row by its id and words: an id may come with several texts
    item = cut_lineage(item.withColumn("item", F.xxhash64("item_id", F.array_join("w", " "))).dropDuplicates(["item"]), "decontaminate-items")
    lengths = sorted(r[0] for r in item.select("k").distinct().collect())  # at most ``words`` numbers
    text = docs.select(col(id_col).alias("doc_id"), words_of(col(text_col)).alias("w")).filter("doc_id IS NOT NULL")
    found = None
    for k in lengths:
        part = _search(text, item.filter(f"k = {k}"), k, percent, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(items.dtypes)[item_col]}, "
                                                     "start int, n_words int, similarity double")
    best = found.join(small(item.select("item", "item_id")), "item").groupBy("doc_id", "item_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.n_words", (-F.col("b.s")).alias("similarity"))


def _search(text: DataFrame, item: DataFrame, k: int, percent: int, radius: int) -> DataFrame:
    item_rows = item.select("item", "m", F.posexplode(shingle_hashes("w", k)).alias("at", "shingle"))
    item_rows = cut_lineage(item_rows, "decontaminate-shingles")
    item_counts = _counts(item_rows, ["item"])

    # the shingles of the documents that some item has
    known = small(item_rows.select("shingle").distinct())
    hashed = text.select("doc_id", F.monotonically_increasing_id().alias("row"), shingle_hashes("w", k).alias("h"))
    hit = hashed.select("doc_id", "row", F.posexplode("h").alias("pos", "shingle")).join(known, "shingle")
    hit = cut_lineage(hit.join(small(item_rows), "shingle").select(
        "doc_id", "item", "m", F.greatest(F.lit(0), F.col("pos") - F.col("at")).alias("start")).distinct(), "decontaminate-windows")

    # the shingles of these windows, from the texts of the documents concerned
    starts = hit.groupBy("doc_id").agg(F.collect_set(F.struct("start", "m")).alias("windows"))
    cut = text.join(small(starts, MOST_STARTS), "doc_id").withColumn("h", shingle_hashes("w", k)).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "h", F.explode("windows").alias("v"))
    window = cut.select("doc_id", "row", "v.start", "v.m", F.explode(F.expr(f"slice(h, v.start + 1, v.m - {k - 1})")).alias("shingle"))
    window = cut_lineage(_counts(window, ["doc_id", "row", "start", "m"]), "decontaminate-window-shingles")

    # candidates and the blocks of the items are written: a plan of the whole search would be planned anew after every stage.
    # A window at the end of a document may be shorter than the item, so its size goes along
    prints = simhash(window, ["doc_id", "row", "start", "m"])
    item_prints = simhash(item_counts.join(item.select("item", "m"), "item"), ["item", "m"]).drop("total")
    left = blocks(prints, radius).alias("d")
    right = small(cut_lineage(blocks(item_prints, radius), "decontaminate-item-blocks")).alias("i")
    near = cut_lineage(left.join(right, F.expr(
        f"d.block = i.block AND d.bits = i.bits AND d.m = i.m AND bit_count(d.fingerprint ^ i.fingerprint) <= {radius}")).select(
        "doc_id", "row", "start", "d.m", "item", F.col("total").alias("size")).distinct(), "decontaminate-candidates")

    shared = near.join(window, ["doc_id", "row", "start", "m"]).join(
        small(item_counts.withColumnRenamed("c", "ci")), ["item", "shingle"])
    overlap = shared.groupBy("doc_id", "row", "start", "m", "item", "size").agg(F.sum(F.least("c", "ci")).alias("common"))
    scored = overlap.withColumn("union", F.expr(f"size + m - {k - 1} - common"))
    return scored.filter(f"100 * common >= {percent} * union").select(
        "doc_id", "item", "start", F.col("m").alias("n_words"), F.expr("common / union").alias("similarity"))
