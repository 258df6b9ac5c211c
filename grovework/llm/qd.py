"""Singular values and right singular vectors of a small square matrix: Householder
bidiagonalisation, dqds for the values, twisted factorisations for the vectors.

The matrix has the order of a vector's length, whatever the number of rows it
came from, so this runs on the driver.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
#: Values whose relative gap is smaller have their vectors made orthogonal to each other.
CLOSE = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of U' M W, and W."""
    m, size = matrix.astype(float).copy(), len(matrix)
    right = np.eye(size)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        """v of length sqrt(2), so that x - v (v'x) has zeros below its first entry."""
        length = np.linalg.norm(x)
        if length == 0:
            return None
        v = x.copy()
        v[0] += math.copysign(length, x[0])
        return v * (math.sqrt(2) / np.linalg.norm(v))

    for k in range(size):
        if (v := mirror(m[k:, k])) is not None:
            m[k:, k:] -= np.outer(v, v @ m[k:, k:])
        if k < size - 2 and (v := mirror(m[k, k + 1 :])) is not None:
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One differential qd transform. The last two results: the value that ended
    it, negative if the shift was too large, and whether that was the last one."""
    d, new_q, new_e = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return q, e, d, False
        top = d + e[k]
        ratio = q[k + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift if top > 0 else q[k + 1] - shift
    return ([*new_q, d], new_e, d, True) if d >= 0 else (q, e, d, True)


def _least_of_two(x: float, y: float, off: float) -> tuple[float, float]:
    """Eigenvalues, the smaller first, of [[x, sqrt(off x)], [., y + off]]: a qd pair."""
    total = x + y + off
    root = math.sqrt(max(0.0, (x - y + off) ** 2 + 4 * off * y))
    large = (total + root) / 2
    return (x * (y / large) if large > 0 else 0.0), large


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), descending: to
    high relative accuracy, as differences are only taken where shifts are."""
    found: list[float] = []
    parts = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while parts:
        q, e, moved = parts.pop()
        for _ in range(60 * len(q) + 100):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS**2 * (moved + min(q[k], q[k + 1])) or e[k] <= EPS**2 * moved or e[k] == 0), None)
            if cut is not None:
                parts += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
                break
            if len(q) == 2:
                found += [x + moved for x in _least_of_two(q[0], q[1], e[0])]
                break
            if 1.5 * q[0] < q[-1]:  # small values belong at the end
                q, e = q[::-1], e[::-1]
            shift = _least_of_two(q[-2], q[-1], e[-1])[0] * (1 - 4 * EPS)
            for tried in range(6):
                new_q, new_e, end, last = _step(q, e, shift)
                if end >= 0:
                    break
                # too far at the last step only: the excess gives a close lower bound
                shift = max(0.0, (shift + end) * (1 - 4 * EPS)) if last and tried < 2 else shift / 4
            else:
                shift = 0.0
                new_q, new_e, _, _ = _step(q, e, 0.0)
            q, e, moved = new_q, new_e, moved + shift
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sort(np.array(found))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers downwards and upwards and the twist terms of B'B - value."""
    size, tiny = len(a), EPS**2 * max(1e-300, float(np.max(np.abs(a)) ** 2))
    d, low = a * a, b / a[:-1]
    down, up, s, p = np.zeros(size - 1), np.zeros(size - 1), np.zeros(size), np.zeros(size)
    apart = d[:-1] * low**2 <= EPS**2 * value  # nothing crosses here
    s[0] = -value
    for k in range(size - 1):
        if apart[k]:
            s[k + 1] = -value
            continue
        pivot = s[k] + d[k]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        down[k] = d[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(size - 2, -1, -1):
        if apart[k]:
            p[k] = d[k] - value
            continue
        pivot = d[k] * low[k] ** 2 + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        ratio = d[k] / pivot
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    return down, up, s + p + value


def vector_at(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, len(down)):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A column for each of the squares `values` (descending). Vectors of close
    values are made orthogonal; where one falls into those before it, the next
    best twist is taken."""
    floor = EPS**2 * max(1e-300, float(np.max(np.abs(a))))
    a = np.where(np.abs(a) > floor, a, floor)
    columns: list[np.ndarray] = []
    first = 0
    for n, value in enumerate(values):
        if n and values[n - 1] - value > CLOSE * values[n - 1]:
            first = n
        down, up, gamma = twisted(a, b, float(value))
        for at in np.argsort(np.abs(gamma), kind="stable").tolist():
            z = vector_at(down, up, at)
            for _ in range(2):
                for other in columns[first:]:
                    z = z - other * (other @ z)
            length = np.linalg.norm(z)
            if length > 0.1:
                break
        columns.append(z / length)
    return np.array(columns).T


def principal(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The squares of the largest singular values, and their right singular
    vectors as columns: at most `most`, and none below 1e-12 of the largest value."""
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.empty(0), np.empty((len(matrix), 0))
    a, b, right = bidiagonal(matrix / scale)
    squares = dqds(a, b)
    kept = squares[:most][squares[:most] > 1e-24 * squares[0]]
    return kept * scale**2, right @ right_vectors(a, b, kept)
