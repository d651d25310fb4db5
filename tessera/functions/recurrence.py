"""Recurrences along time for many assets at once: rows are assets, columns bars, NaN is missing."""

from __future__ import annotations

import numpy as np


def ema(x: np.ndarray, w: int, carry: bool = False) -> np.ndarray:
    """Seeded with the first bar. carry: a missing bar keeps the last value; otherwise it stays missing from there on."""
    alpha = 2.0 / (w + 1)
    out = np.array(x, float)
    for t in range(1, x.shape[1]):
        new = alpha * x[:, t] + (1 - alpha) * out[:, t - 1]
        if carry:
            new = np.where(np.isnan(x[:, t]), out[:, t - 1], np.where(np.isnan(out[:, t - 1]), x[:, t], new))
        out[:, t] = new
    return out


def adaptive(x: np.ndarray, step: np.ndarray, w: int) -> np.ndarray:
    """Each bar goes its own step from the last value towards its value. The first w bars, and bars after a missing one, are their own."""
    out = np.array(x, float)
    for t in range(max(w, 1), x.shape[1]):
        go = ~(np.isnan(out[:, t - 1]) | np.isnan(x[:, t]))
        out[go, t] = (1 - step[go, t]) * out[go, t - 1] + step[go, t] * x[go, t]
    return out


def recurrence(op: str, x: np.ndarray, w: int, kernel: bool, step: np.ndarray | None = None) -> np.ndarray:
    if step is not None:
        return adaptive(x, step, w)
    first = ema(x, w, kernel)
    return 2 * first - ema(first, w, kernel) if op == "DEMA" else first
