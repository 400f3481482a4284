"""Spanning links inside one task: as many as nodes at most, however many pairs there are."""

from __future__ import annotations

import numpy as np


class Union:
    """Labels over numbered nodes; ``add`` merges along pairs, ``links`` returns one link per node that is not a root."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jump = label[label]
                if np.array_equal(jump, label):
                    break
                label[:] = jump

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        return i, self.label[i]
