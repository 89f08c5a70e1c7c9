"""Hard negatives against a comparison of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank string"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256.0):
    points = [(i, v, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
              if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, _, p, label in points:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(p, q)), j, other) for j, _, q, other in points if j != i and len(q) == len(p))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows, is_anchor, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, is_anchor, **options).collect())


@pytest.fixture
def small_packs(monkeypatch):
    for name, value in (("GROUP_ROWS", 40), ("BLOCK_ROWS", 7), ("TILE_ROWS", 8), ("GROUPS_PER_TASK", 2), ("BLOCKS_PER_TASK", 2), ("FIRST_GROUPS", 2), ("SAMPLE_ROWS", 60), ("REFERENCES", 5)):
        monkeypatch.setattr(H, name, value)


def clustered(n, width, seed, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    points = centres[draw.integers(0, 6, n)] + 0.3 * draw.normal(size=(n, width))
    hot = draw.random(n) < 0.35  # a third of the rows have one label
    label = np.where(hot, 0, draw.integers(0, labels, n))
    return [(k, [float(x) for x in p], int(c)) for k, (p, c) in enumerate(zip(points.astype(np.float32), label))]


@pytest.mark.parametrize("width,scale", [(3, 256.0), (16, 4.0), (2, 0.7)])
def test_against_all_pairs(spark, small_packs, width, scale):
    rows = clustered(350, width, width)
    want = brute(rows, lambda i: i % 9 == 0, scale=scale)
    assert len(want) > 100 and got(spark, rows, F.col("vec_id") % 9 == 0, scale=scale) == want


def test_ties_repeated_rows_and_odd_rows(spark, small_packs):
    rows = [(k, [float(k % 3), float(k % 2)], k % 2) for k in range(40)]
    rows += [(40, [2.0, 1.0], 0), (40, [2.0, 1.0], 0), (None, [2.0, 1.0], 0), (41, None, 1), (42, [], 1), (43, [1.0, None], 1), (44, [float("nan"), 1.0], 1),
             (45, [float("inf"), 1.0], 1), (46, [1.0, 1.0], None), (47, [0.0, 0.0], 1), (48, [1.0, 1.0, 1.0], 1), (49, [1.0, 0.5, 1.0], 0), (50, [1.0, 0.0, 1.0], 1), (51, [-1.0, -2.0], 0)]
    want = brute(rows, lambda i: i % 4 == 0 or i > 46)
    assert want and got(spark, rows, (F.col("vec_id") % 4 == 0) | (F.col("vec_id") > 46)) == want


def test_empty_and_lonely(spark):
    assert got(spark, [], F.lit(True)) == []
    assert got(spark, [(1, [1.0], 0)], F.lit(True)) == []
    assert got(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [0.5], 1)], F.lit(False)) == []
    assert got(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [0.5], 1)], F.col("vec_id") == 1) == [(1, 2, 1, 3, 65536, 32768)]


def test_other_windows_and_numbers(spark, small_packs):
    rows = clustered(200, 4, 11)
    options = dict(positives=2, negatives=3, low=-50, high=120)
    assert got(spark, rows, F.col("vec_id") < 20, **options) == brute(rows, lambda i: i < 20, **options)


def test_scores_beyond_a_double_are_exact(spark):
    rows = [(1, [3e6, 1.0], 0), (2, [3e6, 2.0], 0), (3, [2e6, 5.0], 1), (4, [2e6, 5.25], 1)]
    want = brute(rows, lambda i: i == 1)
    assert want[0][5] - want[1][5] == 64 << 8 and got(spark, rows, F.col("vec_id") == 1) == want
    with pytest.raises(ValueError):
        got(spark, [(1, [3e9, 1.0], 0), (2, [3e9, 2.0], 0)], F.lit(True))


def test_windows_and_bounds():
    score = np.array([-7, 0, 1, 3, 10, 101, 2**62])
    least, most = H.window_of(score, 30, 90)
    for s, a, b in zip(score.tolist(), least.tolist(), most.tolist()):
        assert a == -(-30 * s // 100) and b == 90 * s // 100
    draw = np.random.default_rng(1)
    x, y, ref = (np.floor(50 * draw.normal(size=(n, 4))) for n in (40, 60, 6))
    ref /= H.norms_of(ref)[:, None]
    a, b = H.angles_to(x, ref).astype(float)[:, None], H.angles_to(y, ref).astype(float)[None]
    lower, upper = H.score_bounds(*H.angle_bounds((a, a), (b, b)), (H.norms_of(x)[:, None],) * 2, (H.norms_of(y)[None],) * 2)
    exact = x @ y.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower < 2 * H.norms_of(x)[:, None] * H.norms_of(y)).mean() > 0.9


def test_clusters_are_not_scored_against_each_other():
    """The filter rules most out where vectors are clustered; the README has figures for isotropic ones."""
    rows = clustered(2000, 8, 2)
    points = np.floor(256 * np.array([r[1] for r in rows]))
    ref = H.directions(points)
    angles, norms = H.angles_to(points, ref), H.norms_of(points)
    order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))
    arrays = dict(ids=order, labels=np.full(2000, "0"), points=points[order], norms=norms[order], angles=angles[order])
    of = np.arange(20)
    asks = H.Asks(H.dump(**{k: v[::100] for k, v in arrays.items()}, of=of, low=np.full(20, H.LOWEST), low_id=np.full(20, H.NO_ID), high=np.full(20, H.HIGHEST)), 5)
    asks.visit(H.Group(H.dump(**arrays)), True)
    assert asks.scored < 0.5 * 20 * 2000
