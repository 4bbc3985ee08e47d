"""Right singular vectors of one small triangle: Householder bidiagonal form, dqds, twisted factorisations.

``dqds`` transforms the squares q, e of a bidiagonal matrix without subtractions that cancel. Its shift is
1 / sum(1 / d) over the d of the step before, which never passes the least eigenvalue left, so every step is safe; a step
that rounding still drives below zero is repeated without shift.

For an eigenvalue x of B'B = L D L', the twisted factorisation joins the top-down factors of L D L' - x with the
bottom-up ones where |gamma| is least; its one equation gives the vector without a solve. Eigenvalues with a small
relative gap share a space, so their vectors are found by a few steps of inverse iteration through the same factors, each
held orthogonal to those before it.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLOSE = 1e-3
ROUNDS = 5


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor W of r = U B W'."""
    width = r.shape[1]
    a = np.zeros((max(r.shape[0], width), width))
    a[: r.shape[0]] = r
    w = np.eye(width)
    for k in range(width):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(v, v @ a[k:, k:])
        if k + 2 < width:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1)[: width - 1].copy(), w


def _reflector(x: np.ndarray) -> np.ndarray:
    """v with (I - v v') x along the first axis."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0:
        return np.zeros(len(x))
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v * (np.sqrt(2.0) / np.linalg.norm(v))


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform; None when the shift was too great."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for i in range(len(e)):
        ds.append(d)
        if d < 0:
            return None
        top = d + e[i]
        if top <= 0:
            return None
        t = q[i + 1] / top
        qs.append(top)
        es.append(e[i] * t)
        d = d * t - shift
    ds.append(d)
    return None if d < 0 else (qs + [d], es, ds)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Falling eigenvalues of B'B for squares q > 0 and e > 0 of an unreduced bidiagonal matrix."""
    q, e, found, shifted, shift = q.tolist(), e.tolist(), [], 0.0, 0.0
    tiny = (EPS / 8) ** 2
    while q:
        if not e:
            found.append(q[0] + shifted)
            break
        if e[-1] <= tiny * (shifted + q[-1]):
            found.append(q.pop() + shifted)
            e.pop()
            shift = 0.0
            continue
        done = _step(q, e, shift) if shift else None
        if done is None:
            shift = 0.0
            done = _step(q, e, 0.0)
            if done is None:  # a zero pivot: an eigenvalue equal to what was shifted
                q[-1] = 0.0
                e[-1] = 0.0
                continue
        q, e, ds = done
        shifted += shift
        least = min(ds)
        shift = 0.0 if least <= 0 else 1.0 / sum(1.0 / d for d in ds)
        if shift <= EPS * shifted / 8:
            shift = 0.0
    return np.array(sorted(found, reverse=True))


def _factors(d: np.ndarray, low: np.ndarray, x: float):
    """Top-down and bottom-up factors of L D L' - x, and gamma at every twist."""
    n = len(d)
    floor = EPS * EPS * max(abs(x), float(d.max()))
    s, p = np.empty(n), np.empty(n)
    down, up, dp, dm = np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
    s[0] = -x
    for i in range(n - 1):
        pivot = s[i] + d[i]
        dp[i] = pivot if abs(pivot) > floor else np.copysign(floor, pivot)
        down[i] = d[i] * low[i] / dp[i]
        s[i + 1] = down[i] * low[i] * s[i] - x
    p[n - 1] = d[n - 1] - x
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        dm[i + 1] = pivot if abs(pivot) > floor else np.copysign(floor, pivot)
        t = d[i] / dm[i + 1]
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - x
    return down, up, dp, dm, s + p + x


def _twisted(d: np.ndarray, low: np.ndarray, x: float) -> tuple[np.ndarray, float]:
    """Vector of the least |gamma| and its Rayleigh correction of x."""
    down, up, _, _, gamma = _factors(d, low, x)
    r = int(np.abs(gamma).argmin())
    z = np.zeros(len(d))
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, len(d) - 1):
        z[i + 1] = -up[i] * z[i]
    size = float(z @ z)
    return z / np.sqrt(size), float(gamma[r]) / size


def _solve(d: np.ndarray, low: np.ndarray, x: float, right: np.ndarray) -> np.ndarray:
    """(L D L' - x) y = right through the twisted factors N D N'."""
    down, up, dp, dm, gamma = _factors(d, low, x)
    r = int(np.abs(gamma).argmin())
    y = right.astype(float).copy()
    for i in range(r):
        y[i + 1] -= down[i] * y[i]
    for i in range(len(d) - 1, r, -1):
        y[i - 1] -= up[i - 1] * y[i]
    y[:r] /= dp[:r]
    y[r + 1 :] /= dm[r + 1 :]
    least = EPS * EPS * max(abs(x), float(d.max()))
    y[r] /= gamma[r] if abs(gamma[r]) > least else least
    for i in range(r - 1, -1, -1):
        y[i] -= down[i] * y[i + 1]
    for i in range(r, len(d) - 1):
        y[i + 1] -= up[i] * y[i]
    return y


def _block_vectors(diag: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values and right vectors of one unreduced block."""
    if len(diag) == 1:
        return diag * diag, np.ones((1, 1))
    d, low = diag * diag, above / diag[:-1]
    values = dqds(d, above * above)
    out, draw = np.zeros((len(diag), len(diag))), np.random.default_rng(0)
    starts = {j: first for first, last in _runs(values) for j in range(first, last)}
    for j, x in enumerate(values):
        if j not in starts:
            z, step = _twisted(d, low, x)
            for _ in range(2):
                if abs(step) <= EPS * x:
                    break
                z, step = _twisted(d, low, x + step)
        else:
            before = out[:, starts[j] : j]
            z = draw.standard_normal(len(diag))
            for _ in range(ROUNDS):
                z -= before @ (before.T @ z)
                z /= np.linalg.norm(z)
                z = _solve(d, low, x, z)
                z /= np.linalg.norm(z)
            for _ in range(2):
                z -= before @ (before.T @ z)
                z /= np.linalg.norm(z)
        out[:, j] = z
    for first, last in _runs(values):
        out[:, first:last] = _settled(diag, above, out[:, first:last])
    return values, out


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs of more than one close value; values that are zero but for rounding are one run."""
    none = (len(values) * EPS) ** 2 * values[0]
    apart = [values[j - 1] - values[j] > CLOSE * values[j - 1] and values[j - 1] > none for j in range(1, len(values))]
    edges = [0, *[j for j, far in enumerate(apart, 1) if far], len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _settled(diag: np.ndarray, above: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The vectors of a close run told apart inside their own space, by one-sided rotations of B times the space."""
    space = space.copy()
    image = diag[:, None] * space
    image[:-1] += above[:, None] * space[1:]
    k = space.shape[1]
    for _ in range(12):
        turned = False
        for i in range(k - 1):
            for j in range(i + 1, k):
                a, b, c = image[:, i] @ image[:, i], image[:, j] @ image[:, j], image[:, i] @ image[:, j]
                if abs(c) <= EPS * np.sqrt(a * b):
                    continue
                turned = True
                t = 0.5 * np.arctan2(2 * c, a - b)
                rotate = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
                image[:, [i, j]] = image[:, [i, j]] @ rotate
                space[:, [i, j]] = space[:, [i, j]] @ rotate
        if not turned:
            break
    return space[:, np.argsort(-(image * image).sum(axis=0), kind="stable")]


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling singular values of r and their right vectors as columns."""
    width = r.shape[1]
    scale = float(np.abs(r).max(initial=0.0))
    if not scale:
        return np.zeros(width), np.eye(width)
    diag, above, w = bidiagonalise(r / scale)
    size = max(np.abs(diag).max(), np.abs(above).max(initial=0.0))
    # A zero on the diagonal would stop the factors; a change far below rounding does not move the result.
    diag = np.where(np.abs(diag) < EPS * EPS * size, EPS * EPS * size, diag)
    cuts = [0, *[i + 1 for i in range(width - 1) if abs(above[i]) <= EPS * EPS * size], width]
    values, vectors = np.zeros(width), np.zeros((width, width))
    for a, b in zip(cuts, cuts[1:]):
        values[a:b], vectors[a:b, a:b] = _block_vectors(diag[a:b], above[a : b - 1])
    order = np.argsort(-values, kind="stable")
    return np.sqrt(np.maximum(values[order], 0.0)) * scale, w @ vectors[:, order]
