"""Gradient-boosted trees of fixed depth on binned features, for logistic loss, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """depth-3 trees; fit() is deterministic. predict() gives probabilities after Platt scaling on held-out rows."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.model: list[tuple[list[tuple[int, float]], np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        held = np.arange(len(y)) % 5 == 0
        self._boost(x[~held], y[~held])
        raw, target = self.raw(x[held]), y[held]
        for _ in range(300):
            p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
            self.scale -= 0.1 * float(np.mean((p - target) * raw))
            self.shift -= 0.1 * float(np.mean(p - target))
        return self

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        flags = [(j, float(c), x[:, j] > c) for j in range(x.shape[1]) for c in cuts[j]]
        right = np.stack([f for *_, f in flags]).astype(np.float64)
        score = np.zeros(len(y))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node, tests = np.zeros(len(y), np.int64), []
            for level in range(self.depth):  # one test per level: an oblivious tree
                gain = np.zeros(len(flags))
                for k in range(1 << level):
                    own = node == k
                    gr, hr = right[:, own] @ g[own], right[:, own] @ h[own]
                    gs, hs = g[own].sum(), h[own].sum()
                    gain += gr**2 / (hr + self.l2) + (gs - gr) ** 2 / (hs - hr + self.l2)
                j, c, f = flags[int(np.argmax(gain))]
                tests.append((j, c))
                node = node * 2 + f
            leaf = -self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2)
            score += leaf[node]
            self.model.append((tests, leaf))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tests, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for j, c in tests:
                node = node * 2 + (x[:, j] > c)
            out += leaf[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float, rate: float, rows: np.ndarray) -> float:
        """The least probability at and above which the held-out ones of rows reach the precision, if positives were `rate` of all; over 1 if none does."""
        held = (np.arange(len(y)) % 5 == 0) & rows
        p, target = self.predict(x[held]), y[held]
        order = np.argsort(-p, kind="stable")
        weight = np.where(target[order] > 0, 1.0, (1 - rate) / rate * target.sum() / max(1.0, (1 - target).sum()))
        good = np.cumsum(target[order]) / np.cumsum(weight)
        met = np.flatnonzero(good >= precision)
        return float(p[order[met[-1]]]) if len(met) else 1.01
