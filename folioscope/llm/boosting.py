"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth: inner nodes in level order, then leaves.

    A row goes right where its value is above the threshold.  ``base`` is the
    log-odds without any tree.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all rows of a tree level at once."""
        total = np.full(len(values), self.base)
        rows = np.arange(len(values))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(values), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (values[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(values: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 5.0) -> Forest:
    """Fit on the log loss; without both labels there is a constant score, 0.5 without any row."""
    label = np.asarray(label, np.float64)
    share = (label.sum() + 1.0) / (len(label) + 2.0)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(label) == 0 or label.min() == label.max():
        return none
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in values.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, values.T, strict=True)], axis=1)
    total = np.full(len(label), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, curve = chance - label, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(len(label), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for at, e in enumerate(edges):
                if not len(e):
                    continue
                slot = local * bins + binned[:, at]
                g = np.bincount(slot, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(slot, curve, width * bins).reshape(width, bins).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain = gain[:, : len(e)]
                cut = gain.argmax(axis=1)
                value = gain[np.arange(width), cut]
                better = value > best
                best[better] = value[better]
                feature[first : first + width][better] = at
                threshold[first : first + width][better] = e[cut[better]]
            node = 2 * node + 1 + (values[np.arange(len(node)), feature[node]] > threshold[node])
        place = node - inner
        g, h = np.bincount(place, slope, inner + 1), np.bincount(place, curve, inner + 1)
        leaf = -rate * g / (h + ridge)
        total += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)
