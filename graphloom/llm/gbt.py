"""Histogram gradient-boosted trees for a binary label, flattened into arrays and walked by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of equal depth: node i of a tree has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # the same shape; greater goes right
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``; all trees take one level at a time."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        depth = (inner + 1).bit_length() - 1
        tree, out = np.arange(trees), np.empty(len(x))
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            row, node = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[at : at + 1024] = self.leaf[tree, node - inner].sum(axis=1) + self.base
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 2.0, least: float = 8.0, prior: float = 0.5) -> Forest:
    """Newton boosting of the log loss.  Without rows of both labels the forest is a constant: ``prior`` or the only label seen, smoothed."""
    inner = (1 << depth) - 1
    mean = (y.sum() + prior) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) + np.arange(width) * bins
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            begin, count = (1 << level) - 1, 1 << level
            flat = ((node - begin)[:, None] * (width * bins) + code).ravel()
            g, h = (np.bincount(flat, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2) for v in (grad, hess))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = -1
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                if gain.reshape(count, -1)[k, b] > 1e-9:
                    f, cut = divmod(b, bins)
                    feature[begin + k], threshold[begin + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        own = node - inner
        g, h = np.bincount(own, grad, inner + 1), np.bincount(own, hess, inner + 1)
        leaf = rate * g / (h + ridge)
        margin += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the isotonic regression of labels on scores; between knots the line is straight."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots = np.array([(b[2] / b[1], b[0] / b[1]) for b in blocks]).reshape(-1, 2)
    return knots[:, 0], np.clip(knots[:, 1], 0, 1)
