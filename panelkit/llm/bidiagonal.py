"""Singular values and right singular vectors of one small square matrix: Householder bidiagonals, dqds, twisted factors.

Works on a d x d triangle in one process; its size is that of a vector squared and does not grow with the rows.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Neighbouring eigenvalues nearer than this, relatively, are one cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): (I - beta v v') x has zeros after its first entry."""
    v, norm = x.copy(), float(np.linalg.norm(x))
    if norm == 0:
        return v, 0.0
    v[0] += math.copysign(norm, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, W): U' matrix W is upper bidiagonal with diagonal a and superdiagonal b; W is orthogonal. U is not kept."""
    m = np.array(matrix, dtype=np.float64)
    n = len(m)
    right = np.eye(n)
    for k in range(n):
        v, beta = _reflector(m[k:, k])
        m[k:, k:] -= np.outer(beta * v, v @ m[k:, k:])
        if k + 1 < n:
            v, beta = _reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ v, beta * v)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, beta * v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One shifted differential quotient-difference step, and the least of its d values (below 0: the shift was too large)."""
    d, least, qs, es = q[0] - shift, q[0] - shift, [], []
    for i, x in enumerate(e):
        if d < 0:
            return qs, es, d
        up = d + x
        ratio = q[i + 1] / up
        qs.append(up)
        es.append(x * ratio)
        d = d * ratio - shift
        least = min(least, d)
    qs.append(d)
    return qs, es, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal's singular values, falling, each to high relative accuracy.

    A block's last value is found when the off-diagonal entry above it is negligible beside all that was shifted away and
    is left; blocks part where an entry inside is negligible. A shift is no more than the least d of the step before,
    which bounds the least eigenvalue from above; one that is too large is divided by 4, in the end left out.
    """
    found: list[float] = []
    blocks = [([float(x) * float(x) for x in a], [float(x) * float(x) for x in b], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        least, steps = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            small = EPS * EPS * (moved + q[-1])
            if e[-1] <= small or e[-1] <= EPS * EPS * q[-1]:
                found.append(moved + q.pop())
                e.pop()
                continue
            cuts = [i for i in range(n - 1) if e[i] <= EPS * EPS * min(moved + q[i], moved + q[i + 1]) or e[i] == 0]
            if cuts:
                i = cuts[-1]
                blocks.append((q[: i + 1], e[:i], moved))
                q, e, least = q[i + 1 :], e[i + 1 :], 0.0
                continue
            if q[0] < 0.5 * q[-1]:  # small values are found at the end: flip the matrix about its other diagonal
                q, e, least = q[::-1], e[::-1], 0.0
            shift = least * (0.98 if e[-1] < 0.01 * q[-1] else 0.5)
            for attempt in range(4):
                qs, es, d = _dqds(q, e, shift)
                if d >= 0:
                    break
                shift = shift / 4 if attempt < 2 else 0.0
            q, e, least, moved, steps = qs, es, max(d, 0.0), moved + shift, steps + 1
            if steps > 100 * n + 1000:
                raise ArithmeticError("dqds did not converge")
    return np.array(sorted(found, reverse=True))


class _Twisted:
    """B'B - value as a twisted factorisation: downward from the top and upward from the end, meeting where it is nearest to singular."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float) -> None:
        n = len(a)
        tiny = EPS * EPS * max(value, float(np.max(a * a)), 1e-300)
        guard = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
        aa, bb, ab = (a * a).tolist(), (b * b).tolist(), (a[: n - 1] * b).tolist()
        self.down, self.left, s = np.empty(n), np.empty(max(n - 1, 0)), [-value]
        for i in range(n - 1):
            self.down[i] = guard(s[i] + aa[i])
            self.left[i] = ab[i] / self.down[i]
            s.append(bb[i] * s[i] / self.down[i] - value)
        self.up, self.right, p = np.empty(n), np.empty(max(n - 1, 0)), [0.0] * n
        p[n - 1] = aa[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = guard(bb[i] + p[i + 1])
            self.right[i] = ab[i] / self.up[i + 1]
            p[i] = p[i + 1] * aa[i] / self.up[i + 1] - value
        gamma = np.array(s) + np.array(p) + value
        self.at = int(np.argmin(np.abs(gamma)))
        self.gamma = guard(float(gamma[self.at]))

    def vector(self) -> np.ndarray:
        return self._back(np.eye(len(self.down))[self.at])

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        y, n, k = rhs.astype(float).copy(), len(rhs), self.at
        for i in range(k):
            y[i + 1] -= self.left[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.right[i - 1] * y[i]
        y[:k] /= self.down[:k]
        y[k + 1 :] /= self.up[k + 1 :]
        y[k] /= self.gamma
        return self._back(y)

    def _back(self, w: np.ndarray) -> np.ndarray:
        z, k = w.copy(), self.at
        for i in range(k - 1, -1, -1):
            z[i] -= self.left[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] -= self.right[i] * z[i]
        return z / np.linalg.norm(z)


def _within_cluster(factors: _Twisted, earlier: np.ndarray, seed: int) -> np.ndarray:
    """A unit vector of the cluster's space that is orthogonal to its earlier vectors, by inverse iteration."""
    rng = np.random.RandomState(seed)
    z = last = rng.standard_normal(len(earlier))
    for _ in range(5):
        z = z - earlier @ (earlier.T @ z)
        z -= earlier @ (earlier.T @ z)
        norm = float(np.linalg.norm(z))
        if norm < 1e-6:  # nothing of it is left: what it was before this step is as good a member of the cluster
            break
        last = z / norm
        z = factors.solve(last)
    last = last - earlier @ (earlier.T @ last)
    return last / np.linalg.norm(last)


def _block_vectors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of B'B and their unit vectors, as columns."""
    values = squared_singular_values(a, b)
    out = np.empty((len(a), len(a)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[j - 1] and values[j - 1] > (len(a) * EPS) ** 2 * values[0]:
            first = j
        factors = _Twisted(a, b, float(value))
        z = _within_cluster(factors, out[:, first:j], j) if j > first else factors.vector()
        out[:, j] = z
    return values, out


def right_singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s2, V): squared singular values of a square matrix, falling, and its right singular vectors as columns."""
    n = len(matrix)
    scale = float(np.max(np.abs(matrix))) if n else 0.0
    if scale == 0:
        return np.zeros(n), np.eye(n)
    a, b, right = bidiagonalise(matrix / scale)
    ends = [i for i in range(n - 1) if abs(b[i]) <= 0.1 * EPS * min(abs(a[i]) + abs(a[i + 1]), 1.0)]
    values, vectors = np.empty(n), np.zeros((n, n))
    for begin, end in zip([0, *[i + 1 for i in ends]], [*[i + 1 for i in ends], n]):
        values[begin:end], vectors[begin:end, begin:end] = _block_vectors(a[begin:end], b[begin : end - 1])
    order = np.argsort(-values, kind="stable")
    return values[order] * scale * scale, right @ vectors[:, order]
