"""Gradient-boosted trees and isotonic calibration on dense numpy features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Binary classifier: logistic loss, depth-wise histogram trees, Newton leaves."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least: int = 5
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1).astype(np.int64)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _grow(self, binned, edges, g, h):
        """Nodes (feature, threshold, left, right, value); feature -1 is a leaf."""
        nodes: list[list] = []

        def grow(rows, depth) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, 0, 0, -self.rate * gs / (hs + self.ridge)])
            if depth == 0 or len(rows) < 2 * self.least:
                return me
            best = (1e-6, None, None)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl ** 2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs ** 2 / (hs + self.ridge)
                gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] is None:
                return me
            _, f, k = best
            left = binned[rows, f] <= k
            nodes[me][0], nodes[me][1] = f, edges[f][k]
            nodes[me][2] = grow(rows[left], depth - 1)
            nodes[me][3] = grow(rows[~left], depth - 1)
            return me

        grow(np.arange(len(g)), self.depth)
        return np.array(nodes, dtype=np.float64)

    def _apply(self, tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = tree[at, 0].astype(np.int64)
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
            at = np.where(f < 0, at, np.where(go, tree[at, 2], tree[at, 3]).astype(np.int64))
        return tree[at, 4]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._apply(tree, x)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), probabilities ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, last score
    for s, v in zip(score[order], y[order].astype(float), strict=True):
        blocks.append([1.0, v, s])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
            w, m, last = blocks.pop()
            b = blocks[-1]
            b[1] = (b[0] * b[1] + w * m) / (b[0] + w)
            b[0], b[2] = b[0] + w, last
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


def calibrate(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Probabilities between the knots by linear interpolation."""
    return np.interp(score, *knots)
