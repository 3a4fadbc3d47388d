"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most 64 bins at quantiles; each level of a tree is grown from
histograms of gradients; all trees are laid out in flat arrays, which scoring walks for all
rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1. A row goes left where its value is at most the limit."""
        raw = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.limit[node]
                node = np.where(self.left[node] >= 0, self.left[node] + right, node)
            raw += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 5, rate: float = 0.12, bins: int = 64, least: float = 20.0, ridge: float = 1.0) -> Forest:
    """Boost the logistic loss. Without both classes the forest is its base rate alone."""
    weight = np.ones(len(y)) if weight is None else weight
    share = float(np.average(y, weights=weight)) if len(y) else 0.5
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    feature, limit, left, value, roots = [], [], [], [], []
    if len(y) and 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), base)
        width = bins + 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
            start = len(feature)
            roots.append(start)
            at = np.full(len(y), start)
            level = [start]
            feature.append(0), limit.append(0.0), left.append(-1), value.append(-rate * g.sum() / (h.sum() + ridge))
            for _ in range(depth):
                slot = np.full(len(feature) - start, -1)
                slot[np.array(level) - start] = np.arange(len(level))
                own = slot[at - start]
                inside = own >= 0
                best = [(1e-3, -1, -1)] * len(level)
                for f in range(x.shape[1]):
                    cell = own[inside] * width + binned[inside, f]
                    hg = np.bincount(cell, g[inside], len(level) * width).reshape(-1, width).cumsum(1)
                    hh = np.bincount(cell, h[inside], len(level) * width).reshape(-1, width).cumsum(1)
                    gt, ht = hg[:, -1:], hh[:, -1:]
                    gain = hg**2 / (hh + ridge) + (gt - hg) ** 2 / (ht - hh + ridge) - gt**2 / (ht + ridge)
                    gain[(hh < least / 10) | (ht - hh < least / 10)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    for n, b in enumerate(gain.argmax(1)):
                        if gain[n, b] > best[n][0]:
                            best[n] = (gain[n, b], f, b)
                grown = []
                for node, (_, f, b) in zip(level, best):
                    if f < 0:
                        continue
                    feature[node], limit[node], left[node] = f, float(cuts[f][b]), len(feature)
                    members = at == node
                    for side in (binned[:, f] <= b, binned[:, f] > b):
                        child = members & side
                        at[child] = len(feature)
                        grown.append(len(feature))
                        feature.append(0), limit.append(0.0), left.append(-1), value.append(-rate * g[child].sum() / (h[child].sum() + ridge))
                level = grown
                if not level:
                    break
            raw += np.array(value[start:])[at - start]
    return Forest(base, np.array(roots, int), np.array(feature, int), np.array(limit), np.array(left, int), np.array(value), depth)
