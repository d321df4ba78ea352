"""Sparse linear models in numpy: rows are runs of feature indices, fitted by L-BFGS on the driver."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: indices (int32) and values (float32, or None for ones) end to end, with row starts."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray] | None = None):
        sizes = np.array([len(x) for x in index], np.int64)
        self.n = len(index)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.index = np.concatenate(index).astype(np.int32) if index else np.zeros(0, np.int32)
        self.value = np.concatenate(value).astype(np.float32) if value else None

    def scaled(self, scale: np.ndarray) -> None:
        """Multiply every feature by its scale."""
        by = scale[self.index].astype(np.float32)
        self.value = by if self.value is None else self.value * by

    def dot(self, w: np.ndarray) -> np.ndarray:
        x = w[self.index] if self.value is None else w[self.index] * self.value
        return np.bincount(self.row, weights=x, minlength=self.n)

    def gather(self, error: np.ndarray, dims: int) -> np.ndarray:
        x = error[self.row] if self.value is None else error[self.row] * self.value
        return np.bincount(self.index, weights=x, minlength=dims)


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 60, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Minimise a smooth function that returns its value and gradient."""
    f, g = loss(x)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(a := rho * s.dot(d))
            d = d - a * y
        if past:
            s, y, _ = past[-1]
            d = d * (s.dot(y) / y.dot(y))
        for (s, y, rho), a in zip(past, reversed(alphas)):
            d = d + (a - rho * y.dot(d)) * s
        slope = g.dot(d)
        if slope >= 0:
            past.clear()
            d, slope = -g, -g.dot(g)
        step = 1.0 if past else min(1.0, 1.0 / max(1e-12, np.abs(g).sum()))
        for _ in range(30):
            f2, g2 = loss(x + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = step * d, g2 - g
        if s.dot(y) > 1e-12:
            past.append((s, y, 1.0 / s.dot(y)))
        done = abs(f - f2) <= tolerance * max(1.0, abs(f))
        x, f, g = x + s, f2, g2
        if done:
            break
    return x
