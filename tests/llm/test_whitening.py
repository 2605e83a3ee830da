"""Whitening against plain integers and a plain eigensolver."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, n string, deviation string, component string, i string, v string, dims string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, None, *"abcdef") for k, v in rows], SCHEMA).repartition(parts)


def plain(vectors):
    """(deviations, covariance, centred rows) of lists of finite floats, in whole numbers and fractions."""
    x = [[floor(Fraction(float(np.float32(c))) * 64) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    cov = [[float(Fraction(sum(a[i] * a[j] for a in apart), n**3)) for j in range(len(sums))] for i in range(len(sums))]
    return [sum(c * c for c in a) for a in apart], np.array(cov), np.array([[float(Fraction(c, n)) for c in a] for a in apart])


def some(seed, rows, dims):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((rows, dims)) @ rng.standard_normal((dims, dims)) * 3 + rng.random(dims) * 100).astype(np.float32)


@pytest.mark.parametrize(("rows", "dims"), [(200, 7), (120, 40)])
def test_whitening_against_plain(spark, rows, dims):
    from stockmerge.llm.whitening import whiten

    good = [(i // 2, v.tolist()) for i, v in enumerate(some(1, rows, dims))] + [(None, some(2, 1, dims)[0].tolist()), (3, some(1, rows, dims)[5].tolist())]
    bad = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)), (904, [1.0, None] * (dims // 2)), (905, []), (906, [1.0])]
    got = whiten(frame(spark, good + bad)).collect()
    deviation, cov, centred = plain([v for _, v in good])
    k = min(32, dims)
    assert len(got) == len(good) * k and {r["n"] for r in got} == {len(good)} and {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    for c in range(k):
        own = [r for r in got if r["component"] == c + 1]
        assert own[0]["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-10) and own[0]["identity_error"] <= 1e-9
        want = {d: w for d, w in zip(deviation, centred @ axes[:, c] / np.sqrt(values[c]), strict=True)}
        sign = np.sign(own[0]["whitened"] * want[own[0]["deviation"]])
        assert np.allclose([r["whitened"] * sign for r in own], [want[r["deviation"]] for r in own], atol=1e-7)
    white = np.array([[r["whitened"] for r in sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"])) if r["component"] == c + 1] for c in range(k)])
    assert np.abs(np.cov(white, bias=True) - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_no_variance_gives_no_rows(spark, rows):
    from stockmerge.llm.whitening import whiten

    assert whiten(frame(spark, rows)).collect() == []


def test_constant_and_repeated_dimensions_are_left_out(spark):
    from stockmerge.llm.whitening import whiten

    rows = [(i, [float(a), 5.0, float(a), float(b)]) for i, (a, b) in enumerate(np.random.default_rng(3).integers(0, 50, (90, 2)))]
    got = whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9


def test_large_entries_stay_exact(spark):
    from stockmerge.llm.whitening import whiten

    rows = [(i, [float(2**30 * (i % 3)), float(i)]) for i in range(40)]
    got = {(r["vec_id"], r["deviation"]) for r in whiten(frame(spark, rows)).collect() if r["component"] == 1}
    want, _, _ = plain([v for _, v in rows])
    assert got == {(i, w if w < 2**63 else None) for i, w in enumerate(want)} and any(w >= 2**63 for w in want)
    assert whiten(frame(spark, [*rows, (99, [3e38, 0.0]), (98, [-3e38, 0.0])])).count() == 42  # beside those the other dimension is rounding


@pytest.mark.parametrize("kind", ["apart", "cluster", "equal", "tiny"])
def test_eigenvectors_to_double_precision(kind):
    from stockmerge.llm.whitening import eigen

    rng = np.random.default_rng(7)
    d = 48
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"apart": 1 + rng.random(d) * 100, "cluster": np.r_[50 + np.arange(12) * 1e-7, rng.random(d - 12)], "equal": np.r_[[9.0] * 5, [4.0] * 10, rng.random(d - 15)], "tiny": np.r_[rng.random(20) * 1e-8, 1 + rng.random(d - 20)]}[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = eigen(a)
    wide, of = x.astype(np.longdouble), a.astype(np.longdouble)
    assert (np.diff(got) <= 0).all()
    assert np.abs(wide.T @ wide - np.eye(d)).max() < 1e-15
    assert np.abs(wide.T @ of @ wide - np.diag(got)).max() < 2e-15 * np.abs(values).max()
    if kind == "cluster":  # vectors of a cluster are its own to as many digits as the matrix gives them
        best = x[:, np.argsort(-got)[:12]]
        want = q[:, :12][:, ::-1]
        assert np.abs(np.abs(best.T @ want) - np.eye(12)).max() < 1e-5
