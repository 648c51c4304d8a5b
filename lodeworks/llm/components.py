"""Connected components of the links that one task holds, in numpy; those of a table are in ``operators.graph``."""

from __future__ import annotations

import numpy as np


def smallest_reached(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links u-v lead to."""
    label = np.arange(n)
    if not len(u):
        return label
    ends, others = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.argsort(ends, kind="stable")
    ends, others = ends[order], others[order]
    first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
    while True:
        new = label.copy()
        new[ends[first]] = np.minimum(label[ends[first]], np.minimum.reduceat(label[others], first))
        new = new[new]
        if (new == label).all():
            return label
        label = new
