"""Links that a task found, cut down to a forest that connects the same nodes."""

from __future__ import annotations

import numpy as np


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the links a-b that is not itself the smallest."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        lower = label.copy()
        for side in (left, right):
            np.minimum.at(lower, side, least)
            np.minimum.at(lower, label[side], least)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]
