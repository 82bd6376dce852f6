"""Isotonic calibration: a rising curve from raw scores to probabilities, fitted to weighted points."""

from __future__ import annotations

import numpy as np


def fit_isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, probability) of the rising step fit, one for each step, at its weighted middle.

    Steps that violate the order are pooled with their neighbours. Without points the curve is 0.5.
    """
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, weight * y, weight * x
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        if w <= 0:
            continue
        blocks.append([w, w * b, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    made = np.array(blocks)
    return made[:, 2] / made[:, 0], made[:, 1] / made[:, 0]


def calibrate(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities for raw scores: linear between knots, level outside; within 0 and 1.

    A share of 1e-6 of the raw score's rank keeps the order of scores on level parts.
    """
    x, p = knots
    flat = np.interp(score, x, p)
    return np.clip((1 - 2e-6) * flat + 1e-6 * (1 + np.tanh(score / (1 + np.abs(x).max()))), 0.0, 1.0)
