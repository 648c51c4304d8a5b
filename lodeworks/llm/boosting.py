"""Gradient-boosted trees for two classes on a bounded sample, with isotonic calibration; numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Trees of one depth as heaps: node i has the children 2i + 1 and 2i + 2; rows with x[feature] > cut go to the second one. A node
    that isn't split sends all rows to the first."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = self.leaf.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Trees that lower the logistic loss step by step, each split the best one over histograms of at most BINS bins a feature;
    ``least``: the sum of second derivatives that a side of a split needs. Rows of both classes are needed."""
    n, p = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(p)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b - 1] < x <= cuts[b]
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(n, start), (1 << depth) - 1
    features, places, leaves = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        feature, place, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            gain_best, own = np.full(width, 1e-9), node - first
            for j in range(p):
                size = len(cuts[j]) + 1
                if size == 1:
                    continue
                at = own * size + binned[:, j]
                gs, hs = (np.bincount(at, weights=v, minlength=width * size).reshape(width, size).cumsum(1) for v in (g, h))
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > gain_best
                gain_best[better] = top[better]
                feature[first : first + width][better] = j
                place[first : first + width][better] = cuts[j][b[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > place[node])
        own = node - inner
        leaf = rate * np.bincount(own, weights=g, minlength=inner + 1) / (np.bincount(own, weights=h, minlength=inner + 1) + ridge)
        margin += leaf[own]
        features.append(feature)
        places.append(place)
        leaves.append(leaf)
    return Trees(start, np.stack(features), np.stack(places), np.stack(leaves))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest score, probability) of each step of the rising step function nearest to ``y``; equal scores are one step."""
    values, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # lowest score, positives, rows
    for v, pos, n in zip(values, np.bincount(at, weights=y), np.bincount(at)):
        blocks.append([v, pos, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, pos, n = blocks.pop()
            blocks[-1][1] += pos
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
