"""Spectra of scatter matrices under rank-one updates, in numpy.

A ``Spectrum`` holds the number, mean, eigenvalues and eigenvectors of the scatter matrix (sum of centred outer products)
of the vectors seen so far. A new vector is one centred rank-one update; two spectra are joined by one update for the
distance of their means and one for each eigenpair of the smaller rank.

An update of ``diag(d) + rho * z z'``: components of ``z`` that cannot matter, and all but one component of equal
eigenvalues, are deflated; the others' new eigenvalues are the roots of the secular equation
``1 + rho * sum(z_i**2 / (d_i - x)) = 0``, one between each two neighbours. Roots are kept as distances from the nearer
neighbour, and eigenvectors come from the ``z`` for which the roots found are exact, so that they stay orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """Differences ``d[i] - root[k]`` as a matrix ``(i, k)``; ``d`` ascending and distinct, ``z2`` the squares of ``z``, all > 0.

    All roots are searched at once, each between brackets that shrink in every step: a step of the rational interpolation
    that keeps the two neighbouring poles, or half of the bracket where that leaves it.
    """
    n = len(d)
    gaps = np.append(np.diff(d), rho * z2.sum())
    weight = rho * z2
    k = np.arange(n)
    # The sign at the middle tells which neighbour is nearer; the last root has only one.
    middle = 1 + (weight[:, None] / ((d[:, None] - d[None, :]) - gaps[None, :] / 2)).sum(axis=0)
    near = np.where((middle >= 0) | (k == n - 1), k, k + 1)
    offset = d[:, None] - d[near][None, :]  # distances of all poles from each root's origin
    left = near == k
    low = np.where(left, 0.0, -gaps / 2)
    high = np.where(left, np.where(k == n - 1, gaps, gaps / 2), 0.0)
    x = (low + high) / 2
    lower = np.arange(n)[:, None] <= k[None, :]
    right = np.minimum(k + 1, n - 1)
    for _ in range(80):
        poles = offset - x[None, :]
        terms = weight[:, None] / poles
        slopes = terms / poles
        f = 1 + terms.sum(axis=0)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done = np.abs(f) <= 4 * EPS * n * (1 + np.abs(terms).sum(axis=0))
        if np.all(done | (high - low <= EPS * np.maximum(np.abs(low), np.abs(high)))):
            break
        # Replace the sums of the poles below and above by one pole each, with the right value and slope.
        a, b = poles[k, k], poles[right, k]
        below, above = (slopes * lower).sum(axis=0), (slopes * ~lower).sum(axis=0)
        c = f - a * below - np.where(k == n - 1, 0.0, b * above)
        p, q = below * a * a, np.where(k == n - 1, 0.0, above * b * b)
        # c + p / (a - t) + q / (b - t) = 0, solved for the step t.
        u, v, w = c, c * (a + b) + p + q, c * a * b + p * b + q * a
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(v * v - 4 * u * w, 0))
            big = v + np.where(v >= 0, root, -root)
            steps = np.stack([2 * w / big, big / (2 * u)])
            inside = (x + steps > low) & (x + steps < high) & np.isfinite(steps)
            step = np.where(inside[0], steps[0], np.where(inside[1], steps[1], np.nan))
            single = np.where(k == n - 1, a + p / c, np.nan)
            step = np.where((k == n - 1) & (x + single > low) & (x + single < high), single, step)
        x = np.where(np.isfinite(step) & ~done, x + step, np.where(done, x, (low + high) / 2))
    return offset - x[None, :]


def updated(d: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors (diag(d) + rho z z') vectors'``, ``d`` ascending, ``rho >= 0``."""
    size = np.linalg.norm(z)
    if rho <= 0 or size == 0:
        return d, vectors
    z, rho = z / size, rho * size * size
    tolerance = 8 * EPS * max(np.abs(d).max(), rho)
    d = d.copy()
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    # Equal eigenvalues: turn their plane so that one of the two components becomes zero.
    close = np.flatnonzero(np.diff(d[live]) <= tolerance) if len(live) > 1 else ()
    if len(close):
        vectors, z = vectors.copy(), z.copy()
        last = live[0]
        for i in live[1:]:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if (d[i] - d[last]) * abs(c * s) <= tolerance:
                z[last], z[i] = 0.0, r
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            last = i
        live = np.flatnonzero(rho * np.abs(z) > tolerance)
        order = np.argsort(d[live], kind="stable")
        live = live[order]
    if not len(live):
        return d, vectors
    own, part = d[live], z[live]
    poles = roots(own, part * part, rho)
    grown = own - poles.diagonal()
    # The z for which these roots are exact (Loewner's formula), in products of ratios near one.
    apart = own[None, :] - own[:, None]  # d_k - d_i at (i, k)
    np.fill_diagonal(apart, 1.0)
    ratios = -poles / apart
    exact = np.sqrt(np.abs(np.prod(ratios, axis=1)))
    exact = np.copysign(exact, part)
    turn = exact[:, None] / poles
    turn /= np.linalg.norm(turn, axis=0)
    d[live] = grown
    moved = vectors.copy()
    moved[:, live] = vectors[:, live] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], moved[:, order]


class Spectrum:
    """Number, mean, eigenvalues (ascending) and eigenvectors (columns) of the scatter of vectors seen so far."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """A vector that occurs ``times`` times: the scatter grows by one multiple of the outer product of its distance from the mean."""
        apart = x - self.mean
        total = self.n + times
        self.values, self.vectors = updated(self.values, self.vectors, self.vectors.T @ apart, self.n * times / total)
        self.mean += apart * (times / total)
        self.n = total

    def join(self, other: Spectrum) -> None:
        """All vectors of another spectrum."""
        if not other.n:
            return
        total = self.n + other.n
        apart = other.mean - self.mean
        for value, vector in [(self.n * other.n / total, apart), *zip(other.values, other.vectors.T)]:
            self.values, self.vectors = updated(self.values, self.vectors, self.vectors.T @ vector, max(float(value), 0.0))
        self.mean += apart * (other.n / total)
        self.n = total
