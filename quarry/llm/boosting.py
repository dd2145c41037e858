"""Gradient-boosted trees of fixed depth for a small table of candidates (logistic loss)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete binary trees; inner nodes in heap order. Fitting is deterministic."""

    def __init__(self, depth: int = 3, trees: int = 80, rate: float = 0.2, bins: int = 32, least: int = 10, penalty: float = 1.0):
        self.depth, self.trees, self.rate, self.bins, self.least, self.penalty = depth, trees, rate, bins, least, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # <= edge goes left
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        rate = y.mean().clip(1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                best = 1e-6
                for j, e in enumerate(edges):
                    if not len(e) or len(at) < 2 * self.least:
                        continue
                    n, gs, hs = (np.cumsum(np.bincount(code[at, j], w, len(e) + 1))[:-1] for w in (None, g[at], h[at]))
                    ga, ha = g[at].sum(), h[at].sum()
                    gain = gs**2 / (hs + self.penalty) + (ga - gs) ** 2 / (ha - hs + self.penalty) - ga**2 / (ha + self.penalty)
                    gain[(n < self.least) | (len(at) - n < self.least)] = 0
                    if gain.max() > best:
                        best, self.feature[t, k], self.cut[t, k] = gain.max(), j, e[gain.argmax()]
                node[at] = 2 * k + 1 + (x[at, self.feature[t, k]] > self.cut[t, k])
            leaf = node - inner
            self.leaf[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.penalty)
            f += self.leaf[t, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += leaf[node - len(feature)]
        return f

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))
