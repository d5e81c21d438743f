"""Whitening against eigenvectors of the exact covariance, and exact sums by hand."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, whitened double, n long")


def by_hand(rows, width):
    """vec_id and integers of the rows that take part; exact sums."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ints = [(i, [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for i, v in good]
    return ints, [sum(x[k] for _, x in ints) for k in range(width)]


def check(spark, rows, width, components=None):
    found = whitening.fit(vectors(spark, rows))
    got = whitening.by_component(whitening.whitened(vectors(spark, rows).repartition(3), found), found).collect()
    ints, sums = by_hand(rows, width)
    n = len(ints)
    held = lambda v: v if v < 1 << 63 else None
    want = sorted(((i, held(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))) for i, x in ints), key=repr)
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=repr) == want
    exact = [[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for _, x in ints]
    x = np.array(exact)
    _, spread, _ = np.linalg.svd(x, full_matrices=False)
    e = spread**2 / n
    size = min(32, int((spread > spread[0] * 1e-12).sum())) if components is None else components
    assert {r["component"] for r in got} == set(range(1, size + 1)) and len(got) == n * size
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-4
    share = {r["component"]: r["explained"] for r in got}
    np.testing.assert_allclose([share[k + 1] for k in range(size)], (e / e.sum())[:size], rtol=1e-4)
    w = np.zeros((n, size))
    place = {}
    for i, _ in ints:
        place.setdefault(i, []).append(len(place))
    if len(place) == n:
        for r in got:
            w[list(place).index(r["vec_id"]), r["component"] - 1] = r["whitened"]
        np.testing.assert_allclose(w.T @ w / n, np.eye(size), atol=1e-4)
        back = x @ found.directions.T / np.sqrt(found.eigenvalues)
        np.testing.assert_allclose(w, back, atol=1e-6)
        v = x.T @ x / n
        np.testing.assert_allclose(found.directions @ v, found.directions * found.eigenvalues[:, None], atol=1e-9 * e[0])
    return found


def test_whitened_rows_are_uncorrelated(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 40)) @ draw.normal(size=(40, 40)) * 3 + draw.normal(size=40) * 100
    check(spark, [(i, v) for i, v in enumerate(x.tolist())], 40, 32)


def test_far_apart_eigenvalues(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 6)) * [1e9, 1e6, 1e4, 10, 1, 0.05]
    x[:, :3] = x[:, :3] @ np.linalg.qr(draw.normal(size=(3, 3)))[0]
    found = check(spark, [(i, v) for i, v in enumerate(x.tolist())], 6)
    assert found.eigenvalues[0] / found.eigenvalues[-1] > 1e16


def test_dependent_and_constant_dimensions(spark):
    draw = np.random.default_rng(5)
    x = draw.integers(-9, 9, size=(200, 3)) / 2
    x = np.column_stack([x, x[:, 0], np.full(200, 7.0), x[:, 1] * 2])
    found = check(spark, [(i, v) for i, v in enumerate(x.tolist())], 6)
    assert len(found.eigenvalues) == 3


def test_odd_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(50, 4)).tolist())]
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [math.nan] * 4), (63, [math.inf, 0.0, 0.0, 0.0]), (64, []), (65, [2.0]),
             (None, [3.0, 4.0]), (66, [0.0] * 5)]
    check(spark, [*rows, (67, [0.0, 1.0, 0.0, 0.0, -2.0])], 5)
    check(spark, [*rows, (3, rows[3][1]), (3, rows[3][1]), (64, [])], 5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.fit(vectors(spark, rows))
    assert found is None
    empty = whitening.by_component(whitening.whitened(vectors(spark, rows), found), found)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]


def test_deviations_that_no_long_holds(spark):
    rows = [(1, [1e17, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 3.0])]
    found = whitening.fit(vectors(spark, rows))
    # Entries are cut at 2^55, which leaves the first sum at 320 and the second at 384.
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(vectors(spark, rows), found).collect()}
    assert got == {1: None, 2: None, 3: (3 * 320 - 320) ** 2 + (3 * 192 - 384) ** 2}
    x, n = np.array([[3 << 30]]), 1
    at = lambda v: whitening.Whitening(n, np.array([v]), [0], (), x, x, x, x, x)
    edge = 3037000499  # the largest whole root below 2^63
    assert whitening.deviations(at(0), np.array([[edge], [edge + 1], [-edge]])).to_pylist() == [edge**2, None, edge**2]


def test_blocked_solve():
    draw = np.random.default_rng(7)
    r = np.triu(draw.normal(size=(70, 70))) + 9 * np.eye(70)
    x = draw.normal(size=(11, 70))
    np.testing.assert_allclose(whitening.solved(x, r) @ r, x, atol=1e-10)
