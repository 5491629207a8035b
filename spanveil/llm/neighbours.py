"""Approximate nearest neighbours by collision counting (query-aware hashing).

Vectors are dealt into blocks; a block keeps, for each of ``PROJECTIONS`` random
directions, its vectors sorted by that single projection.  A query opens a window
around its own projection in each sorted array and widens all of them step by
step (virtual rehashing): a step only visits what the windows newly cover and counts a
collision for each vector met.  Vectors with collisions in ``SHARE`` of the
arrays are verified by their exact cosine.  A block is done with a query when its
windows are as wide as the distance of the last of the k nearest verified so far
(which is never less than the true one), or cover everything.  The
best k over all blocks are the answer.

Every vector is indexed and every query meets every block, block against block; no task
holds more than one block of vectors and one of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import col, cut_lineage

PROJECTIONS, SHARE = 48, 0.64
#: first half-width of the windows (unit vectors), and its factor from step to step
FIRST, FACTOR = 0.3, 1.35
#: vectors and queries of a block
BLOCK, QUERY_BLOCK = 8192, 1024


def directions(dim: int, m: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, m))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest magnitude where squares would overflow or vanish; the cosine stays."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.where((top > 1e100) | (top < 1e-100), x / top, x)


class SortedProjections:
    """The sorted arrays of one block."""

    def __init__(self, x: np.ndarray, m: int = PROJECTIONS, seed: int = 11):
        self.x, self.norm = x, np.sqrt((x * x).sum(axis=1))
        self.a = directions(x.shape[1], m, seed)
        p = (x / self.norm[:, None]) @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p.T, self.order, axis=1)

    def search(self, q: np.ndarray, k: int, own: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the vectors verified for ``q``; ``own`` masks those that take no part."""
        n, m = len(self.x), len(self.order)
        q_norm = np.sqrt((q * q).sum())
        at = (q / q_norm) @ self.a
        lo = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, at, strict=True)])
        hi, count, seen = lo.copy(), np.zeros(n, dtype=np.int64), own.copy()
        ids, scores = np.empty(0, np.int64), np.empty(0)
        need, width = int(np.ceil(share * m)), FIRST
        while True:
            fresh = []
            for j in range(m):
                a, b = np.searchsorted(self.sorted[j], (at[j] - width, at[j] + width))
                if a < lo[j]:
                    fresh.append(self.order[j, a:lo[j]])
                    lo[j] = a
                if b > hi[j]:
                    fresh.append(self.order[j, hi[j]:b])
                    hi[j] = b
            if fresh:
                count += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((count >= need) & ~seen)
            if len(new):
                seen[new] = True
                ids = np.concatenate((ids, new))
                scores = np.concatenate((scores, (self.x[new] * q).sum(axis=1) / (self.norm[new] * q_norm)))
            if seen.all():
                return ids, scores
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                if width >= np.sqrt(max(0.0, 2 - 2 * kth)):
                    return ids, scores
            width *= FACTOR


def _search_block(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            ids = vectors["id"].to_numpy()
            index = SortedProjections(scaled(np.stack(vectors["v"].to_list()).astype(np.float64)))
            asked = scaled(np.stack(queries["v"].to_list()).astype(np.float64))
            for qid, q in zip(queries["id"], asked, strict=True):
                pos, score = index.search(q, k, ids == qid)
                best = np.lexsort((ids[pos], -score))[:k]
                out += [(qid, ids[pos[i]], score[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the ``k`` nearest found for each query.

    Nearest first, ties to the smaller id; all candidates if there are fewer.  Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null id, take no part; vectors of other length
    than the query's are no candidates.  A query whose id comes with several vectors asks with the
    smallest of them; a row with the query's id is never its neighbour.  Other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v"))
        return v.filter("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity') AND NOT isnan(x)) "
                        "AND exists(v, x -> x <> 0)")
    rows = clean(vectors).withColumn("dim", F.size("v"))
    asked = cut_lineage(clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "neighbour-queries")
    blocks = max(1, -(-rows.count() // block))
    parts = max(1, -(-asked.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumn("b", deal(blocks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("p", deal(parts)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("dim", "b", "p").cogroup(right.groupBy("dim", "b", "p")).applyInPandas(
        _search_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
