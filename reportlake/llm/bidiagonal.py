"""Singular values and right singular vectors of a small square matrix through a bidiagonal form.

Householder reflections bring R to an upper bidiagonal B = U' R P. The dqds transform finds
the squared singular values of B by products and quotients of positive numbers, so small
ones keep their digits; shifts are lower bounds by Newton's step on the last transform, so
no step overshoots. A twisted factorisation of B'B - value gives the vector of each value.
The work depends on the number of columns alone.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TIED = 1e-6  # values that lie closer, relatively, get vectors made orthogonal to each other


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and the orthogonal P with R = U B P'."""
    a = np.array(r, dtype=np.float64)
    n = len(a)
    p = np.eye(n)
    for k in range(n):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k < n - 2:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
            p[:, k + 1 :] -= np.outer(p[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _reflector(x: np.ndarray) -> np.ndarray:
    """A unit vector whose reflection takes ``x`` to a multiple of the first axis."""
    v = x.copy()
    norm = float(np.linalg.norm(v))
    if norm == 0:
        return v
    v[0] += norm if v[0] >= 0 else -norm
    return v / np.linalg.norm(v)


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds step: the new q and e, and the pivots; None if the shift was too large."""
    new_q, new_e, pivots = [], [], []
    d = q[0] - shift
    for i, x in enumerate(e):
        if d < 0:
            return None
        pivots.append(d)
        total = d + x
        new_q.append(total)
        if total:
            ratio = q[i + 1] / total
            new_e.append(x * ratio)
            d = d * ratio - shift
        else:
            new_e.append(0.0)
            d = q[i + 1] - shift
    if d < 0:
        return None
    pivots.append(d)
    new_q.append(d)
    return new_q, new_e, pivots


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, falling.

    Each turn is a step without shift, whose pivots d bound the smallest value: it is at
    most the least d and at least 1 / sum(1 / d). A step with a shift in between follows,
    which is taken back towards the lower bound where it was too large.
    """
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(upper).max(initial=0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    q = [float(x) for x in (diagonal / scale) ** 2]
    e = [float(x) for x in (upper / scale) ** 2]
    found, moved = [], 0.0
    while q:
        if len(q) == 1 or e[-1] <= EPS * EPS * (moved + q[-1]):
            found.append(moved + q.pop())
            e = e[: len(q) - 1]
            continue
        if q[0] < q[-1]:  # the smallest values are found at the end
            q.reverse()
            e.reverse()
        q, e, pivots = _transform(q, e, 0.0)
        least = min(pivots)
        bound = 1.0 / sum(1.0 / d for d in pivots) if least > 1e-290 else 0.0
        for shift in (0.97 * least, (least + bound) / 2, (least + 7 * bound) / 8, 0.999 * bound):
            step = _transform(q, e, shift) if shift > EPS * EPS * moved else None
            if step:
                q, e, _ = step
                moved += shift
                break
        if moved and max(q[-1], e[-1]) <= EPS * EPS * moved:
            q[-1], e[-1] = 0.0, 0.0
    return np.sort(np.array(found))[::-1] * scale * scale


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twisted factorisations of L D L' - value: multipliers from the top, from the bottom, and all twists."""
    n = len(d)
    top, bottom = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    from_top, from_bottom = np.zeros(n), np.zeros(n)
    tiny = EPS * EPS * (abs(value) + float(d.max()))
    s = -value
    for i in range(n - 1):
        from_top[i] = s
        pivot = (s + d[i]) or tiny
        top[i] = d[i] * low[i] / pivot
        s = top[i] * low[i] * s - value
    from_top[-1] = s
    p = d[-1] - value
    for i in range(n - 2, -1, -1):
        from_bottom[i + 1] = p
        p = p or tiny
        pivot = (d[i] * low[i] ** 2 + p) or tiny
        bottom[i] = low[i] * d[i] / pivot
        p = d[i] / pivot * p - value
    from_bottom[0] = p
    return top, bottom, from_top + from_bottom + value


def _solved(top: np.ndarray, bottom: np.ndarray, k: int) -> np.ndarray:
    n = len(top) + 1
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -top[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -bottom[i] * z[i]
    return z / np.linalg.norm(z)


def leading_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit right singular vector in each row, for the given squared singular values.

    The twist with the smallest pivot gives the vector. Vectors of tied values are made
    orthogonal, from the next twists where the first ones give the same vector again.
    """
    a = np.array(diagonal, dtype=np.float64)
    scale = float(np.abs(a).max(initial=0) + np.abs(upper).max(initial=0)) or 1.0
    a[np.abs(a) < EPS * EPS * scale] = EPS * EPS * scale
    d, low = a * a, np.asarray(upper) / a[:-1]
    found = []
    for j, value in enumerate(values):
        tied = [z for z, other in zip(found, values[:j]) if other - value <= TIED * values[0]]
        top, bottom, twists = _twisted(d, low, float(value))
        best, most = None, 0.0
        for k in np.argsort(np.abs(twists)):
            z = _solved(top, bottom, int(k))
            for _ in range(2):
                for other in tied:
                    z = z - (z @ other) * other
            norm = float(np.linalg.norm(z))
            if norm > most:
                best, most = z / norm, norm
            if norm > 0.3:
                break
        found.append(best)
    return np.array(found)


def leading_components(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All eigenvalues of R'R, falling, and unit eigenvectors in rows for the first ``count``."""
    diagonal, upper, p = bidiagonal(r)
    values = squared_singular_values(diagonal, upper)
    return values, values[:count], leading_vectors(diagonal, upper, values[:count]) @ p.T
