"""Quality scores by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; learned filters of 8 bytes run over it every 4
bytes.  The text is covered whole by chunks of 512 bytes, each overlapping the next by
half; a filter's value for a chunk is its maximum there.  A small hidden layer
turns the maxima of a chunk into a logit, and the mean of the chunk logits into
one probability.  The network is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample_ids, sample_rows, score_rows
from .shingles import text_bytes
from .util import col, sheltered

#: labelled rows fitted on, at most, and chunks of a text seen in one training step
SAMPLE, TRAIN_CHUNKS = 12_000, 3
#: bytes of a unit (the stride; a filter spans two), units of a block (half a chunk)
UNIT, BLOCK = 4, 64
EMBED, FILTERS, HIDDEN = 8, 24, 16
#: blocks scored at a time
PIECE = 2048


def to_blocks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each with a unit of zero bytes before and at least one after it (so no
    filter sees two texts), filled up to whole blocks, two at least; and the number of blocks before each text and in all."""
    data, offsets = text_bytes(column)
    length = np.diff(offsets)
    blocks = np.maximum(2, -(-(length + 2 * UNIT) // (UNIT * BLOCK)))
    upto = np.concatenate(([0], np.cumsum(blocks)))
    padded = np.zeros(int(upto[-1]) * UNIT * BLOCK, dtype=np.uint8)
    for a, b, to in zip(offsets[:-1], offsets[1:], upto[:-1] * UNIT * BLOCK, strict=True):
        padded[to + UNIT:to + UNIT + b - a] = data[a:b]
    return padded, upto


@dataclass
class ByteConv:
    """Parameters as float32 arrays: embed (256, EMBED; row 0 stays zero), filters
    (2 * UNIT * EMBED, FILTERS), shift, hidden and out layers."""

    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    NAMES = ("embed", "filters", "shift", "hidden", "hidden_shift", "out", "out_shift")

    @staticmethod
    def start(seed: int = 7) -> ByteConv:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        embed = f(256, EMBED, scale=0.5)
        embed[0] = 0
        return ByteConv(embed, f(2 * UNIT * EMBED, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), f(FILTERS + 1, HIDDEN, scale=0.3),
                        np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def snapped(self) -> ByteConv:
        """Parameters on binary grids so coarse that every sum of products in ``score`` is exact: scores then do not depend on what else
        is in a batch, nor on the order in which a library adds.  A response is a multiple of 2**-15 below 2**9 (24 bits), a hidden value one
        of 2**-25 below 2**18, rounded to 2**-16, a logit one of 2**-26 below 2**25."""
        on = lambda x, bits, top: np.clip(np.round(x.astype(np.float64) * 2 ** bits) / 2 ** bits, -top, top).astype(np.float32)
        return ByteConv(on(self.embed, 7, 4), on(self.filters, 8, 4), on(self.shift, 15, 256), on(self.hidden, 10, 8), on(self.hidden_shift, 15, 256),
                        on(self.out, 10, 8), on(self.out_shift, 15, 256))

    def responses(self, units: np.ndarray) -> np.ndarray:
        """Filter values at each unit but the last of (..., units, UNIT) bytes."""
        x = self.embed[units].reshape(*units.shape[:-1], UNIT * EMBED)
        half = UNIT * EMBED
        both = x @ np.concatenate((self.filters[:half], self.filters[half:]), axis=1)
        return both[..., :-1, :FILTERS] + both[..., 1:, FILTERS:]

    def chunk_logits(self, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """``fill``: the share of a chunk that holds text, so that a short text is not taken for a monotonous one."""
        wide = [x.astype(np.float64) for x in (self.hidden, self.hidden_shift, self.out, self.out_shift)]
        h = np.maximum(np.column_stack((np.maximum(pooled + self.shift, 0), fill)).astype(np.float64) @ wide[0] + wide[1], 0)
        return (np.round(h * 65536) / 65536) @ wide[2] + wide[3][0]

    def score(self, column: pa.Array) -> np.ndarray:
        """One probability per text; a piece of the bytes at a time, whatever the length of a text."""
        if not len(column):
            return np.empty(0)
        padded, upto = to_blocks(column)
        units = padded.reshape(-1, UNIT)
        total = int(upto[-1])
        pooled, fill = np.empty((total, FILTERS), dtype=np.float32), np.empty(total, dtype=np.float32)
        for b in range(0, total, PIECE):
            e = min(b + PIECE, total)
            part = units[b * BLOCK:e * BLOCK + 1]
            if e == total:
                part = np.concatenate((part, np.zeros((1, UNIT), np.uint8)))
            pooled[b:e] = self.responses(part).reshape(e - b, BLOCK, FILTERS).max(axis=1)
            fill[b:e] = (part[:-1] != 0).reshape(e - b, -1).mean(axis=1)
        # a chunk is two neighbouring blocks of one text
        logits = self.chunk_logits(np.maximum(pooled[:-1], pooled[1:]), (fill[:-1] + fill[1:]) / 2)
        logits[upto[1:-1] - 1] = 0
        mean = np.add.reduceat(np.append(logits, 0.0), upto[:-1]) / (np.diff(upto) - 1)
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def step(self, units: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for chunks (n, 2 * BLOCK + 1, UNIT) of the texts ``doc`` (ascending numbers from 0)."""
        n = len(units)
        r = self.responses(units)
        at = r.argmax(axis=1)
        pooled = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
        fill = (units[:, :-1] != 0).mean(axis=(1, 2), dtype=np.float32)
        a1 = np.column_stack((np.maximum(pooled + self.shift, 0), fill))
        a2 = np.maximum(a1 @ self.hidden + self.hidden_shift, 0)
        z = a2 @ self.out + self.out_shift[0]
        count = np.bincount(doc)
        mean = np.bincount(doc, z) / count
        p = 1 / (1 + np.exp(-np.clip(mean, -30, 30)))
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())
        gz = ((weight * (p - y) / len(y)) / count)[doc].astype(np.float32)
        g2 = np.outer(gz, self.out) * (a2 > 0)
        g1 = ((g2 @ self.hidden.T) * (a1 > 0))[:, :FILTERS]
        rows = np.arange(n)[:, None]
        window = np.concatenate((units[rows, at], units[rows, at + 1]), axis=2)  # n, FILTERS, 2 * UNIT bytes
        x = self.embed[window].reshape(n, FILTERS, -1)
        grad = {"out": a2.T @ gz, "out_shift": gz.sum(keepdims=True), "hidden": a1.T @ g2, "hidden_shift": g2.sum(0), "shift": g1.sum(0),
                "filters": np.einsum("nf,nfk->kf", g1, x), "embed": np.zeros_like(self.embed)}
        back = (g1[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        for d in range(EMBED):
            grad["embed"][:, d] = np.bincount(window.reshape(-1), back[:, d], 256)
        grad["embed"][0] = 0
        return loss, grad


def train(chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConv:
    """Adam over mini-batches of texts; both labels weigh alike up to a factor of 3."""
    net, r = ByteConv.start(seed), np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.25, 0.75)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    m = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    v = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    t, steps = 0, max(1, epochs * -(-len(y) // batch))
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at:at + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            own = np.repeat(np.arange(len(pick)), first[pick + 1] - first[pick])
            _, grad = net.step(chunks[rows], own, y[pick], weight[pick])
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for k in net.NAMES:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                setattr(net, k, (getattr(net, k) - now * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32))
            net.embed[0] = 0
    return net


def training_chunks(column: pa.Array, most: int = TRAIN_CHUNKS) -> list[bytes]:
    """For each text up to ``most`` of its chunks, evenly spread over all of it."""
    padded, upto = to_blocks(column)
    padded = np.append(padded, np.zeros(UNIT, np.uint8))
    size, out = UNIT * BLOCK, []
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        at = np.unique(np.linspace(a, b - 2, min(most, b - a - 1)).round().astype(int))
        out.append(b"".join(np.append(padded[i * size:(i + 2) * size], padded[(i + 2) * size:(i + 2) * size + UNIT] if i + 2 < b
                                      else np.zeros(UNIT, np.uint8)).tobytes() for i in at))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, held_out: int = 1, limit: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> ByteConv:
    """Fits on at most ``limit`` labelled rows whose crc32(id) mod ``mod`` is not ``held_out``; of
    each, up to ``TRAIN_CHUNKS`` chunks spread over the whole text go to one training task
    (12,000 * 3 * 516 bytes at most); only the parameters come to the driver.  An id that repeats is fitted on once.  Without labels every score is near one half."""
    sample = sample_rows(docs.select(col(id_col), col(text_col).alias("text")), sample_ids(labels, label, mod, held_out, limit), id_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(training_chunks(b.column(2)), pa.binary())],
                                             names=["id", "y", "chunks"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if rows:
            width = (2 * BLOCK + 1) * UNIT
            data = np.frombuffer(b"".join(c for _, _, c in rows), np.uint8).reshape(-1, 2 * BLOCK + 1, UNIT)
            doc = np.repeat(np.arange(len(rows)), [len(c) // width for _, _, c in rows])
            net = train(data, doc, np.array([y for _, y, _ in rows], dtype=float))
            parts = [getattr(net, k).astype(np.float32).tobytes() for k in net.NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(net.NAMES), pa.array(parts, pa.binary())], names=["name", "data"])
    cuts = sample.select(F.col("id").cast("string").alias("id"), "y", "text").mapInArrow(cut, "id string, y int, chunks binary")
    net = ByteConv.start()
    for r in cuts.repartition(1).mapInArrow(learn, "name string, data binary").collect():
        setattr(net, r["name"], np.frombuffer(r["data"], np.float32).reshape(getattr(net, r["name"]).shape))
    return net.snapped()


def score_documents(df: DataFrame, model: ByteConv, text_col: str = "text", keep_text: bool = True, out: str = "score") -> DataFrame:
    """``df`` with ``out``, the probability of label 1: null and empty texts count as zero bytes; each row by
    itself, so repeated rows agree exactly.  An input column of that name (in any case) is replaced."""
    return score_rows(df, text_col, lambda: model.score, keep_text, out)


def keep_documents(df: DataFrame, model: ByteConv, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, its columns unchanged whatever they are called, whose score is ``least`` or more."""
    shelter, (text,), back = sheltered(df, text_col)
    return back(score_documents(shelter, model, text).filter(F.col("score") >= least), [])
