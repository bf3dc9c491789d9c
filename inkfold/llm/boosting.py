"""Gradient-boosted trees on dense features with isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 3, 0.2, 64, 5.0, 1.0


@dataclass
class Trees:
    """Complete trees of one depth: per inner node a feature and a threshold, per leaf a value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (1 << DEPTH) + 1]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic loss, second-order leaf values, splits on histograms of quantile bins."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6))
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(n, start)
    inner = (1 << DEPTH) - 1
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            slot = (node - first)[:, None] * BINS + binned
            gain = np.full((count, k), 0.0)
            at = np.zeros((count, k), np.int64)
            for j in range(k):
                gs = np.bincount(slot[:, j], g, count * BINS).reshape(count, BINS).cumsum(axis=1)
                hs = np.bincount(slot[:, j], h, count * BINS).reshape(count, BINS).cumsum(axis=1)
                ws = np.bincount(slot[:, j], weight, count * BINS).reshape(count, BINS).cumsum(axis=1)
                total_g, total_h, total_w = gs[:, -1:], hs[:, -1:], ws[:, -1:]
                s = gs**2 / (hs + RIDGE) + (total_g - gs) ** 2 / (total_h - hs + RIDGE) - total_g**2 / (total_h + RIDGE)
                s[(ws < LEAST) | (total_w - ws < LEAST)] = 0
                s[:, len(edges[j]) :] = 0  # nothing lies above the last edge
                at[:, j] = s.argmax(axis=1)
                gain[:, j] = s.max(axis=1)
            best = gain.argmax(axis=1)
            for c in range(count):
                if gain[c, best[c]] > 1e-9:
                    feature[first + c] = best[c]
                    threshold[first + c] = edges[best[c]][at[c, best[c]]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the weighted non-decreasing fit by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of weights, of weighted labels, of weighted margins
    for m, t, w in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w, w * t, w * m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    w, t, m = np.array(blocks).T
    return m / w, t / w
