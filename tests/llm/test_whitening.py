"""Embedding whitening against dense linear algebra and exact small cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corpusmill.llm import op13_whitening as op
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def faddeev(m):
    """Characteristic polynomial from the constant up, in exact fractions."""
    d = len(m)
    a, out, b = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)], None
    for k in range(1, d + 1):
        b = [[a[i][j] + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        a = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][i] for i in range(d)) / k)
    return [int(v) for v in reversed(out)]


def scatter(x):
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def test_characteristic_polynomial(spark):
    rng = random.Random(1)
    for d, size in ((1, 5), (2, 100), (5, 10**12), (9, 40)):
        m = scatter([[rng.randrange(-size, size) for _ in range(d)] for _ in range(d + 3)])
        assert op.characteristic(spark, m) == faddeev(m)
    blocks = [[4, 0, 0], [0, 4, 0], [0, 0, 0]]
    assert op.characteristic(spark, blocks) == faddeev(blocks)
    assert [p for p in range(100) if op.is_prime(p)] == [p for p in range(2, 100) if all(p % q for q in range(2, p))]


def of_roots(roots):
    c = [1]
    for r in roots:
        c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
    return c


@pytest.mark.parametrize("roots", [[7], [3, 3, 3], [1, 2, 3, 4, 5], [0, 0, 8, 8, 9], [10**30, 10**30 + 1, 5, 5], [2**40, 1, 1, 1, 0], [10**12 + k * k for k in range(12)]])
def test_largest_roots(roots):
    want = sorted((r for r in roots if r), reverse=True)
    for wanted in (1, 2, len(want)):
        got = [(r, off) for r, off, times in op.largest_roots(of_roots(roots), wanted) for _ in range(times)]
        assert len(got) >= min(wanted, len(want))
        for (root, off), exact in zip(got, want):
            assert abs(root - exact) <= off <= Fraction(exact, 1 << 100)


def test_irrational_roots():
    # x^2 - 4 x + 1 and its like: 2 +- sqrt(3)
    (a, off, _), (b, _, _) = op.largest_roots([1, -4, 1], 2)
    assert abs((a - 2) ** 2 - 3) <= 8 * off and abs(a + b - 4) <= 4 * off


def check(rows, got, k=None):
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(np.float64)) + 1e6
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    if k is not None:
        assert sorted(by) == list(range(1, k + 1))
    ints = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*ints)]
    deviation = {key: sum((n * v - s) ** 2 for v, s in zip(row, sums)) for (key, _), row in zip(rows, ints)}
    for c, own in by.items():
        assert len(own) == n and {r.n for r in own} == {n}
        assert all(r.deviation == deviation[r.vec_id] for r in own)
        assert abs(own[0].explained - values[c - 1] / values.sum()) < 1e-9
        assert own[0].identity_error < 1e-9
    w = {c: {r.vec_id: r.whitened for r in own} for c, own in by.items()}
    m = np.array([[w[c][key] for c in sorted(by)] for key, _ in rows])
    assert np.abs(np.cov(m.T, bias=True).reshape(len(by), len(by)) - np.eye(len(by))).max() < 1e-9
    for c in by:  # a component is where it should be if its neighbours are apart
        gaps = np.abs(values - values[c - 1])
        if np.sort(gaps)[1] > 1e-3 * values[0]:
            want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            assert min(np.abs(m[:, c - 1] - want).max(), np.abs(m[:, c - 1] + want).max()) < 1e-6


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = op.query(spark, SMALL).collect()
    assert len(got) == 32 * len(rows)
    check(rows, got, 32)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(0, 3.0 ** (np.arange(5) - 2), 5).tolist()) for i in range(50)]
    good += [(i, good[0][1]) for i in range(50, 60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [1.0, 2.0, float("inf"), 0.0, 0.0]), (104, []), (105, [1.0] * 4), (None, None)]
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in [*good, *bad]], SCHEMA)
    for parts in (1, 6):
        check(good, op.whiten(frame.repartition(parts)).collect(), 5)
    assert op.whiten(frame.limit(0)).count() == 0
    assert op.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "x")] * 3, SCHEMA)).count() == 0
    assert op.whiten(spark.createDataFrame([(1, [], 1, "x")] * 3, SCHEMA)).count() == 0
    keys = op.whiten(spark.createDataFrame([(None, [1.0], 1, "x"), (None, [1.0], 1, "x"), (7, [3.0], 1, "x")], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, round(abs(r.whitened), 9)) for r in keys) == [(0, round(math.sqrt(0.5), 9))] * 2 + [(7, round(math.sqrt(2), 9))]


def test_multiple_and_missing_components(spark):
    # corners of a cube: one threefold root; a fourth dimension repeats the first; a fifth is constant
    corners = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2), 0.5]) for i in range(8)]
    check(corners, op.whiten(spark.createDataFrame([(k, v, 1, "x") for k, v in corners], SCHEMA)).collect(), 3)
    tied = [(k, [*v[:3], v[0]]) for k, v in corners]
    check(tied, op.whiten(spark.createDataFrame([(k, v, 1, "x") for k, v in tied], SCHEMA)).collect(), 3)


def test_very_large_entries(spark):
    big = [(i, [1e30 * (i % 2), 1e15 * i, i * i / 64]) for i in range(20)]
    got = op.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and {r.deviation for r in got} == {None}
    wide = [(i, [1e6 * (i % 2), 1e3 * i, i * i / 64]) for i in range(20)]
    check(wide, op.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect(), 3)


def test_gram_is_exact():
    rng = random.Random(2)
    for size in (1 << 10, 1 << 21, 1 << 40, 1 << 62):
        x = np.array([[rng.randrange(-size, size) for _ in range(3)] for _ in range(50)], np.int64)
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
        assert op.gram(x).tolist() == want
