"""Union-find on arrays."""

from __future__ import annotations

import numpy as np


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least position it is connected to by the links a[i] - b[i].

    Roots are hooked to smaller roots, many links at once, and all paths
    shortened after each round, so chains take few rounds.
    """
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root
