"""Whitening against a brute-force version in exact integers and numpy."""

import math

import numpy as np

from inkweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, k int, component int, n string"


def brute(rows, k=32):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of vectors of one length."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in kept], object)
    n, total = len(kept), x.sum(axis=0)
    centred = (x * n - total).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    z = centred @ u[:, :k] / np.sqrt(e[:k])
    return {(i, c + 1): (n, int(sum((n * a - s) ** 2 for a, s in zip(x[r], total, strict=True))), abs(z[r, c]), e[c] / e.sum()) for r, (i, _) in enumerate(kept) for c in range(min(k, z.shape[1]))}


def vectors(n=400, d=40, seed=2):
    rng = np.random.default_rng(seed)
    data = (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0]).astype(np.float32)
    data[: n // 3] = data[0] + rng.normal(size=(n // 3, d)).astype(np.float32) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [None, [None] * d, [*rows[0][1][1:], float("nan")], [*rows[0][1][1:], float("inf")], [float("-inf")] * d, []]
    return rows, [(1000 + i, v) for i, v in enumerate(bad)]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "y") for i, v in rows], SCHEMA).repartition(parts)


def test_equals_brute_force(spark):
    good, bad = vectors()
    got = whitening.report(frame(spark, good + bad)).collect()
    want = brute(good)
    assert len(got) == len(want) == 400 * 32
    signs = {}
    for r in got:
        n, deviation, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - size) < 1e-8 and abs(r.explained / share - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
        signs.setdefault(r.component, []).append(r.whitened)
    whole = np.array([signs[c] for c in sorted(signs)])
    assert np.abs(whole @ whole.T / 400 - np.eye(32)).max() < 1e-9


def test_states_merge_like_the_whole():
    rng = np.random.default_rng(5)
    y = rng.integers(-900, 900, (300, 6))
    zero = whitening.State(0, np.zeros(6, object), np.zeros(6), np.zeros((6, 6)))
    got = zero
    for part in np.split(y, [0, 1, 100, 101, 299]):
        got = got.merged(whitening.State.of(part, True) if len(part) else zero)
    centred = y - y.mean(axis=0)
    assert got.n == 300 and got.sums.tolist() == y.sum(axis=0).tolist()
    assert np.allclose(got.mean, y.mean(axis=0), rtol=1e-14) and np.allclose(got.scatter, centred.T @ centred, rtol=1e-12)


def test_awkward_rows(spark):
    """Few dimensions, a constant one, repeated and null ids, other lengths, and no rows that can be whitened."""
    rows = [(i, [float(i), float(i * i % 7), 2.5]) for i in range(20)] + [(3, [3.0, 2.0, 2.5]), (None, [1.0, 1.0, 2.5]), (50, [1.0, 2.0]), (51, None)]
    got = whitening.report(frame(spark, rows, 3)).collect()
    assert len(got) == 22 * 2 and {r.component for r in got} == {1, 2} and {r.n for r in got} == {22}
    for none in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)], [(1, [])]):
        assert whitening.report(frame(spark, none, 2)).count() == 0


def test_deviation_is_exact_or_null():
    fitted = whitening.Whitening(2, 3, np.array([0, 0], object))
    assert fitted.deviation(np.array([[1, 2], [2**40, 0], [2**30, 1]])) == [45, None, 9 * (2**60 + 1) if 9 * (2**60 + 1) < 2**63 else None]
