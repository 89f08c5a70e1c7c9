"""The scale of the toxicity score: the minimum of a convex loss, wherever the labels lie."""

from __future__ import annotations

import numpy as np
import pytest

from evalframe.llm.toxicity import inputs, logistic


@pytest.mark.parametrize("heavy", [1, 5, 20, 100])
@pytest.mark.parametrize("rows", [1_000, 5_000, 50_000])
def test_scale_is_the_minimum_where_labels_are_all_but_separated(heavy, rows):
    draw = np.random.default_rng(heavy * rows)
    y = (np.arange(rows) % 10 == 0).astype(float)
    light = draw.uniform(0, 0.9 * heavy, rows) * (draw.random(rows) < 0.3)
    weight = np.where(y == 1, draw.uniform(heavy, 3 * heavy, rows), light)
    x = inputs(weight, draw.integers(20, 400, rows))
    w = np.array(logistic(x, y))
    p = 1 / (1 + np.exp(-(x @ w)))
    gradient = x.T @ (p - y) + np.array([1e-9, 0.05, 0.05]) * w
    assert np.abs(gradient).max() < 1e-4
    assert (p[y == 1] >= 0.5).mean() > 0.95 and (p[y == 0] < 0.5).mean() > 0.95


def test_scale_is_finite_without_overlap_and_keeps_the_share_without_signal():
    y = np.array([0.0, 0.0, 0.0, 1.0])
    apart = inputs(np.array([0.0, 0.0, 0.0, 9.0]), np.array([9, 9, 9, 9]))
    assert np.isfinite(logistic(apart, y)).all() and (((apart @ np.array(logistic(apart, y))) >= 0) == (y == 1)).all()
    flat = inputs(np.zeros(4), np.array([9, 9, 9, 9]))
    assert logistic(flat, y) == pytest.approx((np.log(1 / 3), 0, 0), abs=1e-6)
