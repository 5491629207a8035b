"""Whitening of embeddings by a bidiagonal qd solver.

Entries become whole numbers, so sums and deviations are exact.  The different vectors are centred and reduced by blockwise
QR: a task keeps one triangular matrix, and the matrices of tasks are reduced in groups of ``FAN`` until one is left.
Its singular values and vectors (``singular.py``) give the components.  Every vector is then projected in
batches; the covariance that results is measured over the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .singular import right_vectors
from .util import carried, col, cut_lineage, restored

COMPONENTS = 16
#: triangular matrices reduced by one task
FAN = 16
#: numbers of a block of rows
BLOCK = 1 << 18
#: entries are limited to this size, so that sums of two stay within 64 bits
_MOST = 4e18


def _matrices(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their entries) in blocks for each length (``dim`` only, if given); no row is null."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    for d in np.unique(size) if dim is None else [dim]:
        rows = np.flatnonzero(size == d)
        step = max(1, BLOCK // max(1, int(d)))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            yield part, values[offsets[part][:, None] + np.arange(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit whole numbers, or Python's where these might not do."""
    if not x.size or int(max(x.max(), -x.min())) * n + max(abs(s) for s in sums) < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64) if max(map(abs, sums), default=0) < 1 << 62 else x.astype(object) * n - np.array(sums, dtype=object)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _scaled(deviation: np.ndarray, n: int) -> np.ndarray:
    return (deviation / n).astype(np.float64)


def _squares(deviation: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact; null beyond 64 bits."""
    if deviation.dtype != object and int(np.abs(deviation).max(initial=0)) ** 2 * max(1, deviation.shape[1]) < 1 << 63:
        return pa.array((deviation * deviation).sum(axis=1), pa.int64())
    sums = [sum(int(v) * int(v) for v in row) for row in deviation]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def whole_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(kept, x): the other columns carried in one, and floor(64 c) + 1000000 of each entry; rows whose vector is null or empty or
    holds null or non-finite entries go."""
    names = [c for c in vectors.columns if c.lower() != vector_col.lower()]
    rows = vectors.select(carried(names).alias("kept"), col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    return rows.select("kept", F.expr(f"transform(v, c -> floor(greatest(least(64D * c, {_MOST}D), -{_MOST}D)) + 1000000L)").alias("x"))


def _sums(fit: DataFrame) -> DataFrame:
    """dim, pos, n, total (decimal): sums over the fit list per length and place, added up in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                at = held.setdefault(x.shape[1], [0, 0, 0])
                at[0] += len(x)
                at[1] = at[1] + (x >> 32).sum(axis=0)
                at[2] = at[2] + (x & 0xFFFFFFFF).sum(axis=0)
        for d, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)),
                                              pa.array(high), pa.array(low)], names=["dim", "pos", "n", "high", "low"])
    parts = fit.mapInArrow(run, "dim int, pos int, n long, high long, low long").groupBy("dim", "pos").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return cut_lineage(parts, "whitening-sums")


def _triangles(fit: DataFrame, dim: int, n: int, sums: list[int]) -> DataFrame:
    """k, r: one triangular matrix for all centred rows, reduced over tasks in groups of FAN, in the order of the parts."""
    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, any_rows = np.empty((0, dim)), False
        for batch in batches:
            for _, x in _matrices(batch.column(0), dim):
                r, any_rows = np.linalg.qr(np.vstack((r, _scaled(_centred(x, n, sums), n))), mode="r"), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["k", "r"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        r = np.empty((0, dim))
        for part in group.sort_values("k")["r"]:
            r = np.linalg.qr(np.vstack((r, np.frombuffer(part, "<f8").reshape(-1, dim))), mode="r")
        return pd.DataFrame({"k": [int(group["k"].iloc[0]) // FAN], "r": [r.astype("<f8").tobytes()]})
    out, parts = fit.mapInArrow(reduce_rows, "k long, r binary"), fit.rdd.getNumPartitions()
    while parts > 1:
        out = out.groupBy(F.expr(f"k div {FAN}")).applyInPandas(merge, "k long, r binary")
        parts = -(-parts // FAN)
    return out


def _solve(triangle: DataFrame, dim: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (columns) of the covariance, those of nearly zero left out, and its trace."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(1).to_pylist():
                r = np.zeros((dim, dim))
                upper = np.frombuffer(part, "<f8").reshape(-1, dim)
                r[:len(upper)] = upper
                values, vectors = right_vectors(r, most)
                trace = float((np.sort(np.square(r), axis=None) / n).sum())
                for j in range(min(most, dim)):
                    if values[j] > 0 and np.sqrt(values[j] / values[0]) > 64 * dim * np.finfo(np.float64).eps:
                        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([values[j] / n]), pa.array([trace]),
                                                          pa.array([vectors[:, j].tolist()], pa.list_(pa.float64()))], names=["j", "e", "trace", "v"])
    rows = triangle.mapInArrow(run, "j int, e double, trace double, v array<double>").orderBy("j").collect()  # ``most`` rows
    if not rows:
        return np.empty(0), np.empty((dim, 0)), 0.0
    return np.array([r["e"] for r in rows]), np.array([r["v"] for r in rows]).T, rows[0]["trace"]


def _identity_error(fit: DataFrame, dim: int, n: int, sums: list[int], turn: np.ndarray) -> float:
    """Largest entry of the whitened covariance minus the identity, measured over the fit list."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _matrices(batch.column(0), dim):
                w = _scaled(_centred(x, n, sums), n) @ turn
                first += w.sum(axis=0)
                second += w.T @ w
        both = np.vstack((first, second))
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(both.ravel())], names=["i", "j", "s"])
    # decimals: the sum does not depend on the order of the parts
    parts = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,18)")).alias("s"))
    both = np.zeros((k + 1, k))
    for r in parts.collect():  # (k + 1) k numbers
        both[r["i"], r["j"]] = float(r["s"]) / n
    return float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns of ``vectors`` but the vector, then component (int, from 1), n, deviation, whitened, explained, identity_error: one
    row for each vector and component.

    An entry c becomes the whole number x = floor(64 c) + 1000000.  The fit list holds each different x vector once; n is its
    length, S its sums.  Components are unit eigenvectors of its covariance (divisor n) by falling eigenvalue e, their largest
    entry positive.  deviation is the exact sum of (n x - S)^2 over the dimensions, null beyond 64 bits; whitened is x - S/n on the component
    over sqrt(e); explained is e over the trace; identity_error the largest entry of the covariance of whitened over the fit list minus the identity.

    Rows whose vector is null or empty or holds null or non-finite entries are dropped.  Vectors of different lengths have no common
    covariance: the commonest length of the fit list (ties: the smaller) is taken, others give no rows.  Components of no variance
    (fewer different vectors than dimensions) are left out, so one vector, or copies of one, give no rows, like an empty
    table.  Entries beyond 6e16 count as that much.  Repeated rows and ids, null ids and other columns pass through, but input
    columns named like an added one (in any case) give way.
    """
    added = {"component", "n", "deviation", "whitened", "explained", "identity_error", vector_col.lower()}
    names = [c for c in vectors.columns if c.lower() not in added]
    rows = whole_vectors(vectors.select(*map(col, names), col(vector_col)), vector_col)
    kept_type = rows.schema["kept"]
    schema = T.StructType([kept_type, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    fit = cut_lineage(rows.select("x").distinct().sortWithinPartitions("x"), "whitening-fit")
    totals = _sums(fit)
    best = totals.filter("pos = 0").orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (best[0]["dim"], best[0]["n"]) if best else (0, 0)
    sums = [int(r["high"]) * (1 << 32) + int(r["low"]) for r in totals.filter(F.col("dim") == dim).orderBy("pos").collect()]  # one row a dimension
    values, directions, trace = _solve(_triangles(fit, dim, n, sums), dim, n, components) if n else (np.empty(0), np.empty((0, 0)), 0.0)
    k = len(values)
    turn = directions / np.sqrt(values) if k else np.empty((dim, 0))
    error = _identity_error(fit, dim, n, sums, turn) if k else 0.0
    explained = values / trace if k else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                continue
            for part, x in _matrices(batch.column(1), dim):
                deviation = _centred(x, n, sums)
                w = _scaled(deviation, n) @ turn
                again = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(part, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.full(len(part) * k, n, np.int64)), _squares(deviation).take(again), pa.array(w.ravel()), pa.array(np.tile(explained, len(part))),
                     pa.array(np.full(len(part) * k, error))], names=schema.names)
    out = rows.mapInArrow(project, schema)
    return out.select(*restored(names, "kept"), *schema.names[1:])
