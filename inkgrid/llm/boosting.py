"""Gradient-boosted regression trees for two classes, on numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """x: rows by features; y: 0 or 1. With one class only, every score is that class's."""
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        if len(y) < 2 * self.least or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            tree: list[tuple] = []
            leaf = self._grow(b, g, h, np.arange(len(y)), 0, tree)
            for idx, value in leaf:
                f[idx] += value
            self.trees.append(tree)
        return self

    def _grow(self, b, g, h, idx, depth, tree) -> list:
        at = len(tree)
        value = self.rate * g[idx].sum() / (h[idx].sum() + self.ridge)
        tree.append((-1, 0, 0, 0, value))
        if depth == self.depth or len(idx) < 2 * self.least:
            return [(idx, value)]
        best, gs, hs = (1e-6, -1, 0), g[idx].sum(), h[idx].sum()
        whole = gs * gs / (hs + self.ridge)
        for j in range(b.shape[1]):
            k = len(self.edges[j]) + 1
            if k < 2:
                continue
            col = b[idx, j]
            cg, ch, cn = (np.cumsum(np.bincount(col, w, k))[:-1] for w in (g[idx], h[idx], None))
            gain = cg**2 / (ch + self.ridge) + (gs - cg) ** 2 / (hs - ch + self.ridge) - whole
            gain[(cn < self.least) | (len(idx) - cn < self.least)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], j, i)
        if best[1] < 0:
            return [(idx, value)]
        left = b[idx, best[1]] <= best[2]
        out = []
        lo = len(tree)
        out += self._grow(b, g, h, idx[left], depth + 1, tree)
        hi = len(tree)
        out += self._grow(b, g, h, idx[~left], depth + 1, tree)
        tree[at] = (best[1], best[2], lo, hi, value)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = np.asarray(x, np.float64)
        f = np.full(len(x), self.base)
        if self.trees and len(x):
            b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
            for tree in self.trees:
                todo = [(0, np.arange(len(x)))]
                while todo:
                    n, idx = todo.pop()
                    j, cut_, lo, hi, value = tree[n]
                    if j < 0:
                        f[idx] += value
                    elif len(idx):
                        left = b[idx, j] <= cut_
                        todo += [(lo, idx[left]), (hi, idx[~left])]
        return 1 / (1 + np.exp(-f))
