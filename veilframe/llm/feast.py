"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST).

An interval of eigenvalues is circled in the complex plane. Quadrature over the circle of the solves (zI - V)^-1 Y
projects Y onto the eigenvectors inside; Rayleigh-Ritz takes the pairs out of that space, and the round repeats from
them until the residuals stop falling. Where to cut, and that no pair was missed, is told by inertia counts: by
Sylvester's law, V - sI has as many positive pivots as V has eigenvalues over s.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # of the quadrature over the upper half circle
SLICE = 16  # eigenvalues in one interval, unless they lie too close to be cut apart
LOOK_AHEAD = 12  # how far beyond the last wanted pair a gap is looked for
GAP = 1e-6  # least gap, as a share of the largest eigenvalue, at which an interval may end
ROUNDS = 60


class Inertia:
    """How many eigenvalues of a symmetric matrix are over a shift."""

    def __init__(self, v: np.ndarray):
        # An orthogonal congruence to tridiagonal form keeps the inertia of V - sI for every s.
        a, d = v.copy(), len(v)
        for k in range(d - 2):
            x = a[k + 1:, k].copy()
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            x[0] += norm if x[0] >= 0 else -norm
            x /= np.linalg.norm(x)
            a[k + 1:, :] -= 2 * np.outer(x, x @ a[k + 1:, :])
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ x, x)
        self.diagonal, self.squares = np.diag(a).tolist(), (np.diag(a, -1) ** 2).tolist()
        self.tiny = np.finfo(float).tiny

    def over(self, shift: float) -> int:
        """Positive pivots of the LDL' factors of V - sI."""
        n, pivot = 0, 1.0
        for i, at in enumerate(self.diagonal):
            pivot = at - shift - (self.squares[i - 1] / pivot if i else 0.0)
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            n += pivot > 0
        return n

    def bracket(self, k: int, low: float, high: float) -> float:
        """The k-th largest eigenvalue to some 12 digits of the range."""
        for _ in range(42):
            middle = (low + high) / 2
            low, high = (middle, high) if self.over(middle) >= k else (low, middle)
        return (low + high) / 2


def cuts(inertia: Inertia, wanted: int, d: int, top: float) -> list[float]:
    """Falling shifts between eigenvalues; the intervals between them hold the largest ``wanted`` eigenvalues."""
    value = lambda k: inertia.bracket(k, -0.1 * top, 1.1 * top) if k <= d else -0.5 * top
    found, done = [1.2 * top], 0
    while done < wanted:
        first = min(done + SLICE, wanted)
        at = first
        values = {first: value(first)}
        best = (-1.0, first)
        while at <= d:
            values[at + 1] = value(at + 1)
            best = max(best, (values[at] - values[at + 1], at))
            if at >= first + LOOK_AHEAD and best[0] > GAP * top:
                break
            at += 1
        done = best[1]
        found.append((values[done] + values[done + 1]) / 2)
    return found


def inside(v: np.ndarray, low: float, high: float, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``held`` eigenpairs with values between low and high."""
    d, size = len(v), min(len(v), held + held // 2 + 8)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 + nodes))
    y = np.random.default_rng(11).standard_normal((d, size))
    best, stale = None, 0
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for turn, weight in zip(turns, weights):
            shifted = (centre + radius * turn) * np.eye(d) - v
            q += weight / 2 * (radius * turn * np.linalg.solve(shifted, y.astype(complex))).real
        q, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        chosen = np.flatnonzero((values > low) & (values < high))
        if len(chosen) == held:
            vectors = y[:, chosen]
            vectors = vectors / np.linalg.norm(vectors, axis=0)
            worst = np.linalg.norm(v @ vectors - vectors * values[chosen], axis=0).max()
            if best is None or worst < best[0] / 2:
                stale = 0
            else:
                stale += 1
            if best is None or worst < best[0]:
                best = worst, values[chosen][::-1], vectors[:, ::-1]
            if stale >= 2:
                break
    if best is None or best[0] > 1e-9 * max(abs(low), abs(high)):
        raise ArithmeticError(f"{held} eigenvalues lie in an interval in which the projection did not settle")
    return best[1], best[2]


def largest(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues of a symmetric positive semidefinite matrix, falling, and unit vectors in
    columns; fewer where the others are zero to working precision."""
    d, trace = len(v), float(np.trace(v)) if len(v) else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    scaled = v / trace  # the trace bounds the largest eigenvalue
    inertia = Inertia(scaled)
    wanted = min(wanted, inertia.over(d * np.finfo(float).eps))
    top = inertia.bracket(1, 0.0, 1.0 + 1e-9)
    edges = cuts(inertia, wanted, d, top)
    values, vectors = [], []
    for high, low in zip(edges, edges[1:]):
        e, x = inside(scaled, low, high, inertia.over(low) - inertia.over(high))
        values.append(e)
        vectors.append(x)
    return np.concatenate(values)[:wanted] * trace, np.concatenate(vectors, axis=1)[:, :wanted]
