"""Seeds that equal stretches share: the least hash of every window of neighbouring grams."""

from __future__ import annotations

import numpy as np


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours of x (w <= len(x)), by doubling."""
    size, cur = 1, x
    while size * 2 <= w:
        cur = op(cur[:-size], cur[size:])
        size *= 2
    return op(cur[: len(x) - w + 1], cur[w - size : w - size + len(x) - w + 1]) if size < w else cur


def select(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen positions, least hash of each window of w): each window holds a chosen position with its least hash.

    Of equal least hashes close together (as in periodic stretches) only as many are chosen as
    that takes. Fewer hashes than w are one window.
    """
    if not len(h):
        return np.empty(0, np.int64), h
    w = min(w, len(h))
    low = sliding(h, w, np.minimum)
    # a position is least in some window if the highest of the windows' least ones is its own hash
    edge = np.zeros(w - 1, h.dtype)
    at = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), w, np.maximum) == h)
    tie = np.zeros(len(at), bool)
    tie[1:] = (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] < w)
    if tie.any():
        keep = np.ones(len(at), bool)
        last = int(at[0])
        pos = at.tolist()
        for i in range(1, len(pos)):
            if tie[i] and i + 1 < len(pos) and tie[i + 1] and pos[i + 1] - last <= w:
                keep[i] = False
            else:
                last = pos[i]
        at = at[keep]
    return at, low
