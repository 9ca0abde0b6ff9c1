"""Small gradient-boosted trees on the driver's bounded training tables; prediction runs in any worker."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Logistic loss, trees of depth two over at most `cuts` thresholds a feature, Newton leaves, shrunken steps."""

    rounds: int = 60
    rate: float = 0.3
    ridge: float = 2.0
    cuts: int = 16
    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        tests = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts), method="lower"))[:-1]]
        if not tests:
            return self
        right = np.stack([x[:, f] > c for f, c in tests]).astype(np.float64)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(margin)
            g, h = y - p, p * (1 - p)

            def split(rows: np.ndarray, g: np.ndarray = g, h: np.ndarray = h) -> int:
                gr, hr = right @ (g * rows), right @ (h * rows)
                gl, hl = (g * rows).sum() - gr, (h * rows).sum() - hr
                return int((gr**2 / (hr + self.ridge) + gl**2 / (hl + self.ridge)).argmax())

            root = split(np.ones(len(y)))
            sides = [1 - right[root], right[root]]
            lower = [split(s) for s in sides]
            leaves = [float(self.rate * (g * s * t).sum() / ((h * s * t).sum() + self.ridge)) for s, k in zip(sides, lower, strict=True) for t in (1 - right[k], right[k])]
            self.trees.append((tests[root], tests[lower[0]], tests[lower[1]], leaves))
            margin += self._leaf(x, self.trees[-1])
        return self

    @staticmethod
    def _leaf(x: np.ndarray, tree: tuple) -> np.ndarray:
        (f, c), (fl, cl), (fr, cr), leaves = tree
        at = np.where(x[:, f] > c, 2 + (x[:, fr] > cr), x[:, fl] > cl).astype(int)
        return np.array(leaves)[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._leaf(x, t) for t in self.trees), np.zeros(len(x)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic calibration with smoothed targets, by Newton's method."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(margin).std()), 1e-9)
    m, w = np.stack([margin / scale, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(w @ m)
        hessian = (m * (p * (1 - p))) @ m.T + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, m @ (target - p) - 1e-3 * w), -2, 2)
    return float(w[0] / scale), float(w[1])
