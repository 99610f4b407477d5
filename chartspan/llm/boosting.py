"""Small gradient-boosted trees with a logistic loss, fitted on the driver on a bounded sample and applied to arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth as flat arrays: feature and cut of each inner node, value of each leaf."""

    def __init__(self, depth: int, start: float, features: np.ndarray, cuts: np.ndarray, values: np.ndarray):
        self.depth, self.start, self.features, self.cuts, self.values = depth, start, features, cuts, values

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, penalty: float = 1.0) -> Boosted:
    """Newton steps; cuts at quantiles of each feature, whose bins are looked up once and summed for all features together."""
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[:-1])) for f in range(x.shape[1])]
    n_features, width = x.shape[1], bins + 1
    cuts = np.full((n_features, bins), np.inf)
    binned = np.empty(x.shape, np.int64)
    for f, values in enumerate(grid):
        cuts[f, : len(values)] = values
        binned[:, f] = f * width + np.searchsorted(values, x[:, f], side="left")  # at or below values[b]: bin <= b
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    total, parts = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                sums = [np.bincount(binned[at].ravel(), np.repeat(v[at], n_features), n_features * width).reshape(n_features, width) for v in (g, h)]
                left_g, left_h = (np.cumsum(v, axis=1)[:, :-1] for v in sums)
                sum_g, sum_h = g[at].sum(), h[at].sum()
                gain = left_g**2 / (left_h + penalty) + (sum_g - left_g) ** 2 / (sum_h - left_h + penalty) - sum_g**2 / (sum_h + penalty)
                gain[np.isinf(cuts)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-9:
                    feature[k], cut[k] = best // bins, cuts.flat[best]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        total += value[leaf]
        parts.append((feature, cut, value))
    return Boosted(depth, start, *(np.array(z) for z in zip(*parts)))
