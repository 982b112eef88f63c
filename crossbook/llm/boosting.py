"""Small gradient-boosted trees for binary labels: logistic loss, histogram splits, depth-limited."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """fit() on a bounded sample; predict() gives probabilities."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(codes, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            f += self.rate * self._leaves(tree, codes)
            self.trees.append(tree)
        return self

    def _grow(self, codes, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(g / (h + self.l2))
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for j in range(codes.shape[1]):
                c = codes[rows, j]
                n = np.cumsum(np.bincount(c, minlength=self.bins + 1))[:-1]
                a, b = (np.cumsum(np.bincount(c, weights=w[rows], minlength=self.bins + 1))[:-1] for w in (grad, hess))
                gain = a**2 / (b + self.l2) + (g - a) ** 2 / (h - b + self.l2) - g**2 / (h + self.l2)
                gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] is None:
            return leaf
        left = codes[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(codes, grad, hess, rows[left], depth - 1), self._grow(codes, grad, hess, rows[~left], depth - 1)

    def _leaves(self, tree, codes: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(codes), tree)
        j, k, left, right = tree
        return np.where(codes[:, j] <= k, self._leaves(left, codes), self._leaves(right, codes))

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        f = np.full(len(x), self.start)
        for t in self.trees:
            f += self.rate * self._leaves(t, codes)
        return 1 / (1 + np.exp(-f))


def calibrated(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold at which at least `precision` of the rows at or above it are positive; over 1 where there is none."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(good & last)
    return float(p[order][at[-1]]) if len(at) else 2.0
