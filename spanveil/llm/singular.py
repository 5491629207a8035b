"""Singular values and right singular vectors of a small triangular matrix (numpy).

Householder reflections reduce it to a bidiagonal one; dqds with shifts finds the squared singular values
with high relative accuracy (Fernando and Parlett); twisted factorisations of the shifted tridiagonal
matrix, in differential form, give the vectors (Parlett and Dhillon), set right within clusters by
further steps of inverse iteration and orthogonalisation.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_TINY = float(np.finfo(np.float64).tiny)
#: a squared coupling of this share of its neighbours is dropped
_NEGLIGIBLE = (32 * _EPS) ** 2


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta so that (I - beta v v') x is a multiple of the first unit vector."""
    v = x.copy()
    scale = np.abs(x).max() if len(x) else 0.0
    if len(x) < 2 or not np.abs(x[1:]).max():
        return v, 0.0
    v /= scale
    v[0] += np.copysign(np.sqrt(v @ v), v[0])
    return v, 2.0 / (v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of r = U B V', B upper bidiagonal, ``r`` square."""
    a, n = np.array(r, dtype=np.float64), len(r)
    v = np.eye(n)
    for k in range(n):
        h, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * h, h @ a[k:, k:])
        if k < n - 2:
            h, beta = _reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ h, beta * h)
                v[:, k + 1:] -= np.outer(v[:, k + 1:] @ h, beta * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform; None if the shift is beyond the smallest value."""
    out_q, out_e, d = [], [], q[0] - shift
    for i, coupling in enumerate(e):
        if not d >= 0:
            return None
        top = d + coupling
        if top <= _TINY:
            # an exact zero: its value splits off
            out_q.append(0.0)
            out_e.append(0.0)
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / top
        out_q.append(top)
        out_e.append(coupling * ratio)
        d = d * ratio - shift
    return ([*out_q, d], out_e) if d >= 0 else None


def _shift(a: float, b: float, c: float) -> float:
    """The smaller eigenvalue of the last two by two block with squares a, b (coupling) and c."""
    high = (a + b + c) / 2 + math.sqrt(max(0.0, ((a + b - c) / 2) ** 2 + b * c))
    return a * (c / high) if high > 0 else 0.0


def squared_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues (falling) of B'B of a bidiagonal B; q and e are the squares of its two diagonals."""
    out: list[float] = []
    todo = [([float(x) for x in q], [float(x) for x in e], 0.0, 0)] if len(q) else []
    while todo:
        q, e, base, turn = todo.pop()
        n = len(q)
        if n == 1:
            out.append(base + q[0])
            continue
        if max(q) + max(e) <= 4 * _EPS * base:
            out += [base + x for x in q]
            continue
        split = next((i for i in range(n - 2, -1, -1) if e[i] <= _NEGLIGIBLE * (base + min(q[i], q[i + 1])) or e[i] <= _TINY), None)
        if split is not None:
            todo += [(q[:split + 1], e[:split], base, 0), (q[split + 1:], e[split + 1:], base, 0)]
            continue
        if n == 2:
            low = _shift(q[0], e[0], q[1])
            out += [base + q[0] + e[0] + q[1] - low, base + low]
            continue
        if turn % 8 == 0 and q[0] < q[-1]:
            # small values converge at the end: B' read backwards has the same values
            q, e = q[::-1], e[::-1]
        guess = _shift(q[-2], e[-1], q[-1])
        for shift in (guess * (1 - 8 * _EPS), guess * 0.75, guess * 0.25, 0.0):
            got = _dqds(q, e, shift)
            if got is not None:
                break
        todo.append((*got, base + shift, turn + 1))
    return np.sort(np.array(out))[::-1]


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the stationary (from the top) and progressive (from the bottom) factorisations of B'B - value I, and gamma."""
    n = len(q)
    plus, minus = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    off = np.sqrt(q[:-1] * e)
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i]
        if abs(d) < _TINY:
            d = -_EPS * max(value, _TINY)
        plus[i] = off[i] / d
        s[i + 1] = e[i] * s[i] / d - value if abs(s[i]) < 1e300 else e[i] - value
    # from the bottom: UDU'
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        d = p[i + 1] + e[i]
        if abs(d) < _TINY:
            d = -_EPS * max(value, _TINY)
        minus[i] = off[i] / d
        p[i] = q[i] * p[i + 1] / d - value
    return plus, minus, s + p + value


def _null_vector(plus: np.ndarray, minus: np.ndarray, r: int) -> np.ndarray:
    z = np.zeros(len(plus) + 1)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, len(plus)):
        z[i + 1] = -minus[i] * z[i]
    norm = np.sqrt(z @ z)
    return z / norm


def _tridiagonal(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of B'B."""
    diag = q.copy()
    diag[1:] += e
    return diag, np.sqrt(q[:-1] * e)


def _vectors(q: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for its falling ``values``."""
    n = len(q)
    if n == 1:
        return np.ones((1, len(values)))
    out = np.zeros((n, len(values)))
    diag, off = _tridiagonal(q, e)
    size = max(values[0], _TINY)
    for j, value in enumerate(values):
        plus, minus, gamma = _twisted(q, e, value)
        gamma = np.where(np.isfinite(gamma), np.abs(gamma), np.inf)
        near = [i for i in range(j) if values[i] - value <= 1e-3 * size]
        best = None
        for r in np.argsort(gamma, kind="stable")[:1 + 4 * bool(near)]:
            z = _null_vector(plus, minus, int(r))
            if not np.isfinite(z).all():
                continue
            own = 1.0
            for _ in range(2 if near else 0):
                z = z - out[:, near] @ (out[:, near].T @ z)
                norm = np.sqrt(z @ z)
                own = min(own, norm)
                z = z / norm if norm > 0 else z
            left = diag * z - value * z
            left[:-1] += off * z[1:]
            left[1:] += off * z[:-1]
            rest = np.abs(left).max() if own > 1e-8 else np.inf
            if best is None or rest < best[0]:
                best = (rest, z)
            if rest <= 8 * n * _EPS * size:
                break
        if best is None or best[0] > 1e3 * n * _EPS * size:
            best = (0.0, _iterated(diag, off, value, out[:, near], size, j))
        out[:, j] = best[1]
    return out


def _iterated(diag: np.ndarray, off: np.ndarray, value: float, others: np.ndarray, size: float, seed: int) -> np.ndarray:
    """Inverse iteration kept orthogonal to ``others``, for values that agree to almost all digits."""
    n = len(diag)
    t = np.diag(diag - value) + np.diag(off, 1) + np.diag(off, -1) + np.eye(n) * (4 * _EPS * size)
    z = np.random.default_rng(seed + 1).standard_normal(n)
    for _ in range(5):
        z = z - others @ (others.T @ z)
        z = np.linalg.solve(t, z / np.sqrt(z @ z))
    for _ in range(2):
        z = z - others @ (others.T @ z)
        z = z / np.sqrt(z @ z)
    return z


def right_vectors(r: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The squared singular values of the square matrix ``r`` (falling, all of them) and the right singular vectors of
    the first ``most`` of them as columns.  The largest component of a vector is positive."""
    n = len(r)
    if not n:
        return np.empty(0), np.empty((0, 0))
    scale = np.abs(r).max()
    if not scale:
        return np.zeros(n), np.eye(n)[:, :most]
    d, f, v = bidiagonalise(r / scale)
    # with this choice of signs both diagonals are positive
    v = v * np.cumprod(np.concatenate(([1.0], np.where(d[:-1] * f < 0, -1.0, 1.0))))
    # blocks between negligible couplings
    weak = np.abs(f) <= 2 * _EPS * np.minimum(np.abs(d[:-1]), np.abs(d[1:]))
    weak |= np.abs(f) <= 1e-2 * _EPS * np.abs(np.concatenate((d, f))).max()
    bounds = [0, *(np.flatnonzero(weak) + 1).tolist(), n]
    blocks, order = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        values = squared_values(d[a:b] ** 2, f[a:b - 1] ** 2)
        order += [(-x, len(blocks), i) for i, x in enumerate(values)]
        blocks.append((a, b, values))
    order.sort()
    wanted = order[:most]
    inner = []
    for k, (a, b, values) in enumerate(blocks):
        many = max((i + 1 for _, at, i in wanted if at == k), default=0)
        inner.append(_vectors(d[a:b] ** 2, f[a:b - 1] ** 2, values[:many]) if many else None)
    out = np.empty((n, len(wanted)))
    for j, (_, k, i) in enumerate(wanted):
        a, b, _ = blocks[k]
        x = v[:, a:b] @ inner[k][:, i]
        out[:, j] = x * np.copysign(1.0, x[np.argmax(np.abs(x))])
    return np.array([-x for x, _, _ in order]) * scale * scale, out
