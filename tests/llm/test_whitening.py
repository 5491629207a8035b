"""Whitening against numpy, the qd solver against known cases."""

import math
import random

import numpy as np
import pytest

from spanveil.llm import singular, whitening

RNG = np.random.default_rng(4)
CASES = {
    "flat": RNG.standard_normal((2000, 40)), "falling": RNG.standard_normal((300, 30)) * np.exp(-np.arange(30)),
    "rising": RNG.standard_normal((300, 30)) * np.exp(np.arange(30) / 3), "low rank": RNG.standard_normal((200, 3)) @ RNG.standard_normal((3, 20)),
    "few rows": RNG.standard_normal((3, 20)), "identity": np.vstack([np.eye(12)] * 3), "equal": 3 * np.linalg.qr(RNG.standard_normal((12, 12)))[0],
    "cluster": np.linalg.qr(RNG.standard_normal((100, 20)))[0] * (1 + 1e-13 * np.arange(20)), "one": RNG.standard_normal((9, 1)), "two": RNG.standard_normal((9, 2)),
    "nothing": np.zeros((8, 4)), "large": RNG.standard_normal((50, 6)) * 1e150, "small": RNG.standard_normal((50, 6)) * 1e-150, "ones": np.ones((5, 7)),
}


@pytest.mark.parametrize("name", CASES)
def test_singular(name):
    a = CASES[name]
    r = np.zeros((a.shape[1], a.shape[1]))
    upper = np.linalg.qr(a, mode="r")
    r[:len(upper)] = upper
    values, v = singular.right_vectors(r)
    scale = np.abs(a).max() or 1.0
    b = a / scale
    want = np.linalg.svd(b, compute_uv=False) ** 2
    want = np.concatenate((want, np.zeros(len(values) - len(want))))
    assert np.abs(values / scale / scale - want).max() <= 1e-13 * max(want[0], 1e-300)
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-10
    assert np.abs(b.T @ (b @ v) - v * (values / scale / scale)).max() <= 1e-12 * max(want[0], 1e-300)


def test_small_values_are_accurate():
    """The squared values of a graded bidiagonal matrix are right to almost all digits, the least too."""
    d, f = 10.0 ** -np.arange(0, 12), 0.5 * 10.0 ** -np.arange(0, 11)
    got = singular.squared_values(d ** 2, f ** 2)
    # the product of all is the squared determinant
    assert math.isclose(math.prod(got.tolist()), math.prod((d ** 2).tolist()), rel_tol=1e-12)


SCHEMA = "vec_id long, embedding array<float>, `a.b` string, N int, kept int"


def brute(rows, most):
    ok = [(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in ok if len(v) == 5]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * c - t) / n for c, t in zip(x, s, strict=True)] for x in fit])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in xs:
        d = [n * c - t for c, t in zip(x, s, strict=True)]
        out.setdefault(i, []).append((sum(k * k for k in d), np.abs(np.array([k / n for k in d]) @ v / np.sqrt(e))[:most]))
    return n, e / e.sum(), out


def test_whiten(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(5)], "x", 7, i) for i in range(300)]
    rows += [(300 + i, rows[0][1], "copy", 7, 0) for i in range(50)] + [(5, rows[6][1], "twice", 7, 0), (None, rows[9][1], None, None, None)]
    rows += [(400, None, "", 7, 0), (401, [], "", 7, 0), (402, [1.0, None, 1.0, 1.0, 1.0], "", 7, 0), (403, [1.0, float("nan"), 1.0, 1.0, 1.0], "", 7, 0),
             (404, [1.0, float("inf"), 1.0, 1.0, 1.0], "", 7, 0), (405, [1.0, 2.0], "short", 7, 0)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7), components=4)
    assert out.columns == ["vec_id", "a.b", "kept", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, share, want = brute(rows, 4)
    got = out.collect()
    assert len(got) == 4 * sum(map(len, want.values()))
    for x in got:
        k = x["component"] - 1
        assert x["n"] == n and abs(x["explained"] - share[k]) < 1e-12 and x["identity_error"] < 1e-10
        assert any(x["deviation"] == d and abs(abs(x["whitened"]) - w[k]) < 1e-8 for d, w in want[x["vec_id"]])
    white = np.zeros((300, 4))
    for x in got:
        if x["vec_id"] is not None and x["vec_id"] < 300 and x["a.b"] == "x":
            white[x["vec_id"], x["component"] - 1] = x["whitened"]
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-10


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], "", 1, 1) for i in range(5)], SCHEMA)).count() == 0
    # two different vectors span one component
    out = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0, 0.0], "", 1, 1), (2, [1.0, 2.0, 3.0], "", 1, 1)], SCHEMA)).collect()
    assert sorted((x["vec_id"], x["component"], round(x["whitened"], 9), round(x["explained"], 9)) for x in out) == [(1, 1, -1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_huge_entries(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i)], "", 1, 1) for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=1).collect()
    assert len(out) == 6 and all(x["deviation"] is None and abs(abs(x["whitened"]) - 1) < 1e-9 for x in out)
