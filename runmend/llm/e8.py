"""Cells of the E8 lattice: the lattice point nearest to eight coordinates, and the next.

E8 is the union of D8 (whole numbers with an even sum) and D8 shifted by a half. In either
the nearest point is found by rounding, and moving the coordinate with the largest error
where the sum is odd; moving two or three of the worst coordinates gives its neighbours.
"""

from __future__ import annotations

import numpy as np

# Which of the three coordinates with the largest errors move, by whether the sum is odd.
_MOVES = np.array([[[0, 0, 0], [1, 1, 0], [1, 0, 1], [0, 1, 1]],
                   [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]]], np.int64)


def nearest_points(y: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest of eight candidates for each row of ``y`` (n x 8), nearest
    first, in halves: n x count x 8 integers."""
    found, far = [], []
    rows = np.arange(len(y))[:, None]
    for shift in (0.0, 0.5):
        whole = np.rint(y - shift)
        error = y - shift - whole
        worst = np.argsort(-np.abs(error), axis=1, kind="stable")[:, :3]
        step = np.where(error >= 0, 1.0, -1.0)
        odd = whole.sum(1).astype(np.int64) & 1
        for move in range(4):
            point = whole.copy()
            point[rows, worst] += _MOVES[odd, move] * step[rows, worst]
            point += shift
            found.append(point)
            far.append(((y - point) ** 2).sum(1))
    order = np.argsort(np.stack(far, 1), axis=1, kind="stable")[:, :count]
    points = np.stack(found, 1)
    return np.rint(2 * points[rows, order]).astype(np.int64)
