"""Non-negative least squares by an active set."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, max_iter: int | None = None, tol: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: columns enter the passive set by gradient and leave where they turn negative."""
    m, n = a.shape
    x = np.zeros(n)
    passive = np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0.0)))
    limit = max_iter or 6 * m + 20
    for _ in range(limit):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if not np.isfinite(w[j]) or w[j] <= tol * scale:
            break
        passive[j] = True
        while True:
            idx = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (s > tol).all():
                x[:] = 0
                x[idx] = s
                break
            neg = s <= tol
            cur = x[idx]
            step = np.min(cur[neg] / np.maximum(cur[neg] - s[neg], 1e-300))
            cur = cur + step * (s - cur)
            cur[neg & (cur <= tol)] = 0
            x[:] = 0
            x[idx] = np.maximum(cur, 0)
            passive[idx[x[idx] <= tol]] = False
            if not passive.any():
                break
    return x
