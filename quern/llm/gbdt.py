"""Gradient-boosted trees with histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of complete binary trees of fixed depth. Without both labels it predicts their rate."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.features = np.zeros((0, 2**depth - 1), np.int64)
        self.cuts = np.zeros((0, 2**depth - 1))
        self.leaves = np.zeros((0, 2**depth))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        mean = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(mean / (1 - mean)))
        if not 0 < y.sum() < n:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        # value <= edges[b] falls into bins up to b
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        k = self.bins
        at = np.arange(width) * k + binned
        valid = np.array([[b < len(e) for b in range(k)] for e in edges])
        score = np.full(n, self.base)
        features, cuts, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            tree_f, tree_c = [], []
            for level in range(self.depth):
                count = 2**level
                flat = (node[:, None] * (width * k) + at).reshape(-1)
                shape = (count, width, k)
                sg = np.bincount(flat, np.repeat(g, width), count * width * k).reshape(shape).cumsum(axis=2)
                sh = np.bincount(flat, np.repeat(h, width), count * width * k).reshape(shape).cumsum(axis=2)
                tg, th = sg[:, :, -1:], sh[:, :, -1:]
                gain = sg**2 / (sh + self.l2) + (tg - sg) ** 2 / (th - sh + self.l2) - tg**2 / (th + self.l2)
                gain[~(np.broadcast_to(valid, shape) & (sh >= self.least) & (th - sh >= self.least))] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                f, b = best // k, best % k
                stays = gain.reshape(count, -1).max(axis=1) <= 1e-9
                cut = np.array([np.inf if s else edges[ff][bb] for s, ff, bb in zip(stays, f, b)])
                tree_f.append(f)
                tree_c.append(cut)
                node = node * 2 + (x[np.arange(n), f[node]] > cut[node])
            leaf = -np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.l2) * self.rate
            score += leaf[node]
            features.append(np.concatenate(tree_f))
            cuts.append(np.concatenate(tree_c))
            leaves.append(leaf)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds by row."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            node, first = np.zeros(len(x), np.int64), 0
            for level in range(self.depth):
                node = node * 2 + (x[rows, f[first + node]] > c[first + node])
                first += 2**level
            score += leaf[node]
        return score


class Isotonic:
    """A non-decreasing map from scores to rates, by pooling adjacent violators, linear between the pools' means."""

    def __init__(self) -> None:
        self.x, self.y = np.zeros(1), np.zeros(1)

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        pools: list[list[float]] = []  # weight, sum of labels, sum of scores
        order = np.argsort(score, kind="stable")
        values, first = np.unique(score[order], return_index=True)
        sums, counts = np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(y)))
        for v, s, c in zip(values, sums, counts):
            pools.append([float(c), float(s), float(v * c)])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.x = np.array([p[2] / p[0] for p in pools])
        self.y = np.array([p[1] / p[0] for p in pools])
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)
