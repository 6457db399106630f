"""A random forest of binary classification trees, grown with numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees over bootstrap samples; each split is the best of a few random features at quantile thresholds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 4, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.depth = depth
        self.roots, feature, threshold, left, right, value = [], [], [], [], [], []
        tried = max(1, int(np.sqrt(x.shape[1])) + 1)

        def split(rows):
            best = (0.0, None, None)
            p = y[rows].mean()
            before = len(rows) * p * (1 - p)
            for f in rng.choice(x.shape[1], tried, replace=False):
                column = x[rows, f]
                for t in np.unique(np.quantile(column, np.linspace(0.05, 0.95, 12))):
                    low = column <= t
                    n = int(low.sum())
                    if least <= n <= len(rows) - least:
                        a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                        gain = before - n * a * (1 - a) - (len(rows) - n) * b * (1 - b)
                        if gain > best[0] + 1e-12:
                            best = gain, int(f), float(t)
            return best

        def grow(rows, level):
            at = len(feature)
            for store, start in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (value, float(y[rows].mean()))):
                store.append(start)
            if level < depth and len(rows) >= 2 * least and 0 < value[at] < 1:
                gain, f, t = split(rows)
                if f is not None:
                    low = x[rows, f] <= t
                    feature[at], threshold[at] = f, t
                    left[at], right[at] = grow(rows[low], level + 1), grow(rows[~low], level + 1)
            return at

        for _ in range(trees):
            self.roots.append(grow(rng.integers(0, len(y), len(y)), 0))
        self.feature, self.threshold = np.array(feature), np.array(threshold)
        self.left, self.right, self.value = np.array(left), np.array(right), np.array(value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives in the leaves that each row falls into."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
            total += self.value[at]
        return total / len(self.roots)
