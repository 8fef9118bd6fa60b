"""Spanning forests of the links that one task finds; searches over whole tables are ``strandloom.operators.components``."""

from __future__ import annotations

import numpy as np


def forest(u: np.ndarray, v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes with a link that aren't the least of their component; nodes are 0 to size - 1."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]
