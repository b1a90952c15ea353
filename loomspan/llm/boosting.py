"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """Boosted trees of a fixed depth with logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, leaf: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(width)], 1)
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            size = 2**self.depth - 1
            feature, cut = np.full(size, -1), np.full(size, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                place = node - first
                best = np.full(count, 1e-6)
                for j in range(width):
                    k = len(edges[j]) + 1
                    at = place * k + binned[:, j]
                    gs = np.bincount(at, g, count * k).reshape(count, k).cumsum(1)
                    hs = np.bincount(at, h, count * k).reshape(count, k).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.leaf * 0.05) | (ht - hs < self.leaf * 0.05)] = 0
                    gain = gain[:, :-1]
                    if gain.shape[1]:
                        top = gain.argmax(1)
                        value = gain[np.arange(count), top]
                        better = value > best
                        best = np.where(better, value, best)
                        feature[first : first + count][better] = j
                        cut[first : first + count][better] = edges[j][top[better]]
                f = feature[node]
                right = (f >= 0) & (x[np.arange(n), np.maximum(f, 0)] >= cut[node])
                node = 2 * node + 1 + right
            leaves = node - size
            value = np.bincount(leaves, g, size + 1) / (np.bincount(leaves, h, size + 1) + self.ridge) * self.rate
            self.trees.append((feature, cut, value))
            score += value[leaves]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class."""
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] >= cut[node]))
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))
