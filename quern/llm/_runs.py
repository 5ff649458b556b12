"""Spanning forests of edges in one task, and the walk over whole groups."""

from __future__ import annotations

import numpy as np

from quern.functions.runs import whole_groups as whole_groups


def spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes under edges a-b."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def spanning_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges a-b between ``n`` nodes are in their spanning forest that prefers earlier edges."""
    label, chosen, live = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return chosen
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        best = np.unique(best[best < len(a)])
        chosen[best] = True
        label = spanning(n, a[best], b[best], label)
