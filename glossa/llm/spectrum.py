"""Leading eigenvalues and eigenvectors of a symmetric matrix by slicing its spectrum.

The factors L D Lᵀ of V - s I have as many positive entries in D as V has eigenvalues
above s (Sylvester). Bisection with such counts isolates the k-th largest eigenvalue
between two shifts; Rayleigh quotient iteration from inside converges cubically, and is
started again from a narrower interval if it leaves it. Two more counts, a rounding error
to either side, certify that what was found is the k-th. Eigenvalues that no shift can
tell apart are taken together, with any orthonormal basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rayleigh quotient iterations from one interval.
STEPS = 12

_ALPHA = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``.

    Pivots are chosen as by Bunch and Kaufman; one of order two has an entry of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    nil = np.finfo(float).eps ** 2 * np.abs(a).max(initial=0)
    while len(a):
        n = len(a)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most = column[r - 1] if n > 1 else 0.0
        size = 1
        if max(abs(a[0, 0]), most) <= nil:
            a = a[1:, 1:]
            continue
        if abs(a[0, 0]) < _ALPHA * most:
            other = np.abs(a[r])
            other[r] = 0
            widest = other.max()
            if abs(a[0, 0]) * widest < _ALPHA * most * most:
                to = 0 if abs(a[r, r]) >= _ALPHA * widest else 1
                size = to + 1
                if to != r:
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        if size == 2:
            positive += 1
            (p, q), (_, r) = a[:2, :2].tolist()
            x, y = a[2:, 0], a[2:, 1]
            both = np.outer(x, y)
            rest = r * np.outer(x, x) - q * (both + both.T) + p * np.outer(y, y)
            a = a[2:, 2:] - rest / (p * r - q * q)
        else:
            positive += int(a[0, 0] > 0)
            below = a[1:, 0]
            a = a[1:, 1:] - np.outer(below, below) / a[0, 0]
    return positive


class Spectrum:
    """The eigenvalues of one matrix, by counts that are remembered."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.size = len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max()) if self.size else 0.0
        self.eps = 8 * self.size * np.finfo(float).eps * self.norm
        self.counts: dict[float, int] = {-self.norm - 1: self.size, self.norm + 1: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest counted shifts with the k-th largest eigenvalue between them."""
        low = max(s for s, n in self.counts.items() if n >= k)
        return low, min(s for s, n in self.counts.items() if n < k and s > low)

    def narrowed(self, k: int, done: Callable[[float, float], bool]) -> tuple[float, float]:
        low, high = self.interval(k)
        while not done(low, high) and high - low > self.eps:
            middle = (low + high) / 2
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return low, high

    def isolated(self, k: int) -> tuple[float, float]:
        """An interval with the k-th eigenvalue and no other, or too narrow to cut."""
        return self.narrowed(k, lambda a, b: self.above(a) == k and self.above(b) == k - 1)

    def solved(self, shift: float, right: np.ndarray) -> np.ndarray:
        shifted = self.matrix - shift * np.eye(self.size)
        try:
            return np.linalg.solve(shifted, right)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            return np.linalg.solve(shifted + self.eps * np.eye(self.size), right)

    def vector(self, low: float, high: float) -> tuple[float, np.ndarray] | None:
        """The eigenvalue between the shifts and its vector; None if the iteration leaves."""
        start = np.cos(np.arange(1, self.size + 1, dtype=float) ** 2)
        v, value = start / np.linalg.norm(start), (low + high) / 2
        for step in range(STEPS):
            w = self.solved(value, v)
            w /= np.linalg.norm(w)
            v, before = w, value
            value = float(v @ self.matrix @ v)
            if not low <= value <= high:
                if step:
                    return None
                value = (low + high) / 2
                continue
            if step and abs(value - before) <= self.eps / self.size:
                return value, v
        rest = np.linalg.norm(self.matrix @ v - value * v)
        return (value, v) if rest <= self.eps else None

    def certified(self, k: int, value: float) -> bool:
        return self.above(value + self.eps) < k <= self.above(value - self.eps)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, columns of vectors) of the ``most`` largest eigenvalues that are not nil."""
    found = Spectrum((matrix + matrix.T) / 2)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while found.eps and len(values) < min(most, found.size):
        k = len(values) + 1
        low, high = found.isolated(k)
        many = found.above(low) - found.above(high)
        group = [_alone(found, k, low, high, vectors)] if many == 1 else (
            _cluster(found, low, high, many, vectors)
        )
        for value, vector in group[: most - k + 1]:
            if value <= found.eps:
                return _joined(found, values, vectors)
            if not found.certified(len(values) + 1, value):
                raise ArithmeticError(f"eigenvalue {len(values) + 1} could not be certified")
            values.append(value)
            vectors.append(vector)
    return _joined(found, values, vectors)


def _joined(
    found: Spectrum, values: list[float], vectors: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    if not values:
        return np.zeros(0), np.zeros((found.size, 0))
    return np.array(values), np.linalg.qr(np.stack(vectors, 1))[0]


def _alone(
    found: Spectrum, k: int, low: float, high: float, before: list[np.ndarray]
) -> tuple[float, np.ndarray]:
    """The only eigenvalue between the shifts; iterations that leave start from a narrower place."""
    while high - low > found.eps:
        made = found.vector(low, high)
        if made and found.certified(k, made[0]):
            return made
        cut = (high - low) / 16
        low, high = found.narrowed(k, lambda a, b: b - a <= cut)
    return _cluster(found, low, high, 1, before)[0]


def _cluster(
    found: Spectrum, low: float, high: float, many: int, before: list[np.ndarray]
) -> list[tuple[float, np.ndarray]]:
    """Eigenvalues closer than rounding errors, largest first, by inverse iteration at once."""
    grid = np.arange(1, found.size * many + 1, dtype=float).reshape(found.size, many)
    block = np.cos(grid**2)
    for _ in range(4):
        for v in before:
            block -= np.outer(v, v @ block)
        block, _ = np.linalg.qr(block)
        block = found.solved((low + high) / 2 + found.eps / 3, block)
        block /= np.abs(block).max(axis=0)
    block, _ = np.linalg.qr(block)
    inner, turn = np.linalg.eigh(block.T @ found.matrix @ block)
    block = block @ turn
    return [(float(inner[i]), block[:, i]) for i in range(many - 1, -1, -1)]
