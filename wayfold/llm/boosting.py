"""Histogram gradient-boosted trees for a yes-or-no target, small enough to train where the driver is."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: node k of a tree has the children 2k+1 and 2k+2.

    feature and threshold have a row per tree and a column per inner node, leaf a column per
    leaf. A row goes right where its value is over the threshold; nodes that don't split
    have the threshold infinity.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of x, a level of one tree at a time for all rows."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 1.0, penalty: float = 1.0) -> Trees:
    """Trees for the target y of 0 and 1.

    Values are binned at quantiles once; each level sums gradients by node and bin, and takes
    the split of most gain. Equal gains take the first feature and bin, so a fit is repeatable.
    Without rows, or with one class only, the trees give a constant.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, n, width = 2**depth - 1, len(x), x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), np.int64)
    margin = np.full(n, base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = node - first
            best = np.full(nodes, 1e-6)
            split = np.zeros((nodes, 2), np.int64) - 1
            for j in range(width):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (total_g - gs) ** 2 / (total_h - hs + penalty) - total_g**2 / (total_h + penalty)
                gain[(hs < least) | (total_h - hs < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(nodes), at]
                better = top > best
                best[better] = top[better]
                split[better] = np.stack([np.full(nodes, j), at], axis=1)[better]
            for k in range(nodes):
                if split[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        local = node - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + penalty)
        margin += leaf[local]
        out.append((feature, threshold, leaf))
    parts = [np.array(p) for p in zip(*out, strict=True)] if out else [np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))]
    return Trees(*parts, base)
