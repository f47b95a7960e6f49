"""Histogram gradient-boosted trees in numpy: trained on a bounded sample, flattened into arrays for traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays: node k of a tree splits on feature[k] <= threshold[k] or, if feature[k] < 0, is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row. All rows go down all trees together, a level at a time."""
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        index = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            down = np.where(rows[index, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(feature < 0, at, down)
        return self.base + self.value[at].sum(axis=1)

    def predict(self, rows: np.ndarray, chunk: int = 2048) -> np.ndarray:
        parts = [self.raw(rows[a : a + chunk]) for a in range(0, len(rows), chunk)]
        raw = np.concatenate(parts) if parts else np.empty(0)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between bins: midway between neighbours of the quantiles, so equal values never part."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least_weight: float = 2.0, penalty: float = 1.0) -> Forest:
    """Logistic boosting; each level of a tree sums gradients and curvatures by node, feature and bin in one count.

    Without rows, or with one class, the forest has no trees and gives the (smoothed) share of label 1.
    """
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1.0) if n else 0.5
    base = float(np.log(share / (1 - share)))
    empty = np.empty(0, np.int64)
    if n == 0 or labels.min() == labels.max():
        return Forest(empty, np.empty(0), empty, empty, np.empty(0), empty, 0, base)
    edges = [_edges(rows[:, j], bins) for j in range(rows.shape[1])]
    codes = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    features, raw = rows.shape[1], np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node() -> int:
        for x, start in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            x.append(start)
        return len(feature) - 1

    flat_feature = np.arange(features)[None, :] * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, curve = p - labels, p * (1 - p)
        root = new_node()
        roots.append(root)
        nodes, where = [root], np.zeros(n, np.int64)
        live = np.ones(n, bool)
        leaf_of = np.full(n, root)
        for _level in range(depth):
            if not nodes:
                break
            k = len(nodes)
            key = (where[live, None] * (features * bins) + flat_feature + codes[live]).ravel()
            g = np.bincount(key, np.repeat(gradient[live], features), k * features * bins).reshape(k, features, bins)
            h = np.bincount(key, np.repeat(curve[live], features), k * features * bins).reshape(k, features, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least_weight) | (ht - hl < least_weight)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(k, -1).argmax(axis=1)
            children = []
            target = np.full((k, 2), -1)
            split_feature, split_bin = best // bins, best % bins
            for i, node in enumerate(nodes):
                j, b = int(split_feature[i]), int(split_bin[i])
                if gain[i, j, b] <= 1e-9:
                    continue
                feature[node], threshold[node] = j, float(edges[j][b])
                left[node], right[node] = new_node(), new_node()
                target[i] = len(children), len(children) + 1
                children += [left[node], right[node]]
            rows_live = np.flatnonzero(live)
            own = where[rows_live]
            goes_right = codes[rows_live, split_feature[own]] > split_bin[own]
            to = target[own, goes_right.astype(int)]
            stay = to < 0
            live[rows_live[stay]] = False
            where[rows_live[~stay]] = to[~stay]
            leaf_of[rows_live[~stay]] = np.array(children or [0])[to[~stay]]
            nodes = children
        g = np.bincount(leaf_of, gradient, len(feature))
        h = np.bincount(leaf_of, curve, len(feature))
        for node in set(leaf_of.tolist()):
            value[node] = -rate * float(g[node]) / (float(h[node]) + penalty)
        raw += np.array(value)[leaf_of]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)
