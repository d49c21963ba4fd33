"""Gradient boosted trees for yes or no, in numpy, with calibrated probabilities.

Small on purpose: features are cut into a few bins, trees are complete and of fixed
depth, and a node takes the cut of largest gain over all features at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Trees as rows of (feature, cut) per inner node, in heap order, and of values per leaf; slope and shift calibrate their sum."""

    depth: int = 4
    rate: float = 0.2
    ridge: float = 1.0
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 60, bins: int = 24) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # bin b: at most edges[b]
        n, width, wide = *x.shape, bins + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        total = np.full(n, self.base)
        for _ in range(trees):
            p = _sigmoid(total)
            slope, curve = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            features, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                at = ((node - first)[:, None] * width + np.arange(width)) * wide + binned
                g, h = (np.bincount(at.ravel(), np.repeat(w, width), nodes * width * wide).reshape(nodes, width, wide).cumsum(axis=2) for w in (slope, curve))
                whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.ridge) + (whole_g - g) ** 2 / (whole_h - h + self.ridge) - whole_g**2 / (whole_h + self.ridge)
                best = gain.reshape(nodes, -1).argmax(axis=1)
                for k, b in enumerate(best):
                    f, b = divmod(int(b), wide)
                    if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                        features[first + k], cuts[first + k] = f, edges[f][b]
                node = 2 * node + 1 + (x[np.arange(n), features[node]] > cuts[node])
            leaf = node - (2**self.depth - 1)
            g, h = (np.bincount(leaf, w, 2**self.depth) for w in (slope, curve))
            value = self.rate * g / (h + self.ridge)
            total += value[leaf]
            self.features.append(features)
            self.cuts.append(cuts)
            self.leaves.append(value)
        return self

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            total += leaves[node - (2**self.depth - 1)]
        return total

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 40) -> Boosted:
        """Slope and shift of the sums that fit rows not learnt from (Platt's scaling, by Newton's steps)."""
        z = self.sums(x)
        aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        w = np.array([1.0, 0.0])
        design = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(steps):
            p = _sigmoid(design @ w)
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hessian, design.T @ (p - aim) + 1e-3 * (w - [1.0, 0.0]))
        self.slope, self.shift = map(float, w)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.sums(x) + self.shift)
