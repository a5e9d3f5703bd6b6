"""Gradient-boosted trees on the log loss, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node k has the children 2k + 1 and 2k + 2."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    bias = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(x), bias), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        at = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            where = at - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = where * (len(c) + 1) + binned[:, f]
                gs = np.bincount(cell, g, width * (len(c) + 1)).reshape(width, -1)
                hs = np.bincount(cell, h, width * (len(c) + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                feature[first : first + width][better] = f
                cut[first : first + width][better] = c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge)
        margin += leaf[at - inner]
        features.append(feature)
        thresholds.append(cut)
        leaves.append(leaf)
    return Trees(bias, np.array(features), np.array(thresholds), np.array(leaves))
