"""Leading eigenpairs of a dense symmetric matrix: Householder tridiagonalisation, Sturm-count bisection for the
eigenvalues, inverse iteration with reorthogonalisation inside clusters for the vectors."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def tridiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and unit reflection vectors of ``Q' a Q``; the k-th reflection acts below row k."""
    a = np.array(a, np.float64)
    n = len(a)
    reflections: list[np.ndarray | None] = []
    for k in range(n - 2):
        column = a[k + 1:, k].copy()
        if not column[1:].any():
            reflections.append(None)
            continue
        length = np.copysign(np.linalg.norm(column), column[0])
        v = column
        v[0] += length
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -length
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def back(reflections: list[np.ndarray | None], y: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the full matrix."""
    y = y.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        if v is not None:
            y[k + 1:] -= 2 * (v @ y[k + 1:]) * v
    return y


def count_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues below each shift: negative pivots of the shifted matrix."""
    least = np.finfo(np.float64).tiny + EPS * EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0))
    pivot = diagonal[0] - shifts
    found = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        found += pivot < 0
    return found


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected until no double lies between the ends."""
    beside = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diagonal - beside).min()), np.full(k, (diagonal + beside).max())
    margin = EPS * max(abs(low[0]), abs(high[0])) * len(diagonal) + np.finfo(np.float64).tiny
    low, high = low - margin, high + margin
    wanted = len(diagonal) - np.arange(k)  # that many eigenvalues are at most the wanted one
    for _ in range(2000):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = count_below(diagonal, off, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low + (high - low) / 2


class _Shifted:
    """LU factors of a shifted tridiagonal matrix with row exchanges; zero pivots become tiny ones."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
        n = len(diagonal)
        self.lower, self.main, self.upper = off.tolist(), (diagonal - shift).tolist(), off.tolist()
        self.second, self.swapped = [0.0] * n, [False] * n
        for i in range(n - 1):
            below = self.lower[i]
            if abs(self.main[i]) >= abs(below):
                if self.main[i] == 0:
                    self.main[i] = least
                self.lower[i] = below / self.main[i]
                self.main[i + 1] -= self.lower[i] * self.upper[i]
            else:
                factor = self.main[i] / below
                self.swapped[i], self.lower[i], self.main[i] = True, factor, below
                self.upper[i], self.main[i + 1] = self.main[i + 1], self.upper[i] - factor * self.main[i + 1]
                if i < n - 2:
                    self.second[i], self.upper[i + 1] = self.upper[i + 1], -factor * self.upper[i + 1]
        if abs(self.main[-1]) < least:
            self.main[-1] = least

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        n = len(x)
        for i in range(n - 1):
            if self.swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= self.lower[i] * x[i]
        for i in range(n - 1, -1, -1):
            if i < n - 1:
                x[i] -= self.upper[i] * x[i + 1]
            if i < n - 2:
                x[i] -= self.second[i] * x[i + 2]
            x[i] /= self.main[i]
        return np.array(x)


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues by inverse iteration.

    Values closer than a thousandth of the norm form a cluster: a vector is made orthogonal to the earlier ones
    of its cluster in every round, and equal values are shifted apart a little.
    """
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(np.float64).tiny)
    start = np.random.default_rng(0)
    found: list[np.ndarray] = []
    first, last = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        shift = min(value, last - 10 * EPS * norm) if j > first else value
        last = shift
        factors = _Shifted(diagonal, off, shift, EPS * norm)
        y = start.standard_normal(len(diagonal))
        for _ in range(rounds):
            y = factors.solve(y / np.abs(y).max())
            for other in found[first:] + found[first:]:
                y -= (other @ y) * other
            y /= np.linalg.norm(y)
        found.append(y)
    return np.array(found).reshape(len(values), len(diagonal))


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest eigenvalues above rounding, falling, and their unit vectors as rows.

    The entry of a vector with the largest magnitude is positive.
    """
    n = len(a)
    if not n or not np.abs(a).max():
        return np.zeros(0), np.zeros((0, n))
    diagonal, off, reflections = tridiagonalise(a)
    values = largest(diagonal, off, min(k, n))
    values = values[values > 8 * n * EPS * values[0]]
    found = []
    for y in vectors(diagonal, off, values):
        v = back(reflections, y)
        v /= np.linalg.norm(v)
        found.append(v * np.copysign(1.0, v[np.abs(v).argmax()]))
    return values, np.array(found).reshape(len(values), n)
