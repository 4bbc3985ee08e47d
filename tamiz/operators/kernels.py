"""Small numeric helpers that run inside tasks on a bounded set of centres."""

from __future__ import annotations

import numpy as np

CELLS = 4_000_000  # float cells of one temporary block


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of ``a`` by rows of ``b``."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def ward_costs(rows: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Squared Ward height of joining each cluster in ``rows`` (indices) with every cluster."""
    d = distances(centres[rows], centres)
    n = sizes[rows, None]
    cost = 2.0 * n * sizes[None, :] / (n + sizes[None, :]) * d * d
    cost[np.arange(len(rows)), rows] = np.inf
    return cost


def ward_merges(centres: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges ``(squared height, a, b)`` down to one cluster, where cluster a absorbs b."""
    centres, sizes = centres.astype(float).copy(), sizes.astype(float).copy()
    live = np.ones(len(centres), bool)
    out: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(out) < len(centres) - 1:
        if not chain:
            chain = [int(np.argmax(live))]
        a = chain[-1]
        gap = centres - centres[a]
        cost = 2.0 * sizes[a] * sizes / (sizes[a] + sizes) * np.einsum("ij,ij->i", gap, gap)
        cost[~live] = np.inf
        cost[a] = np.inf
        b = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            out.append((float(cost[b]), a, b))
            total = sizes[a] + sizes[b]
            centres[a] = (sizes[a] * centres[a] + sizes[b] * centres[b]) / total
            sizes[a], live[b] = total, False
            chain = chain[:-2]
        else:
            chain.append(b)
    return out


def cut_merges(n: int, merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Labels 0.. of the k clusters left after the n - k lowest merges, in order of first member."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(n - k, 0)]:
        parent[root(b)] = root(a)
    return first_seen(np.array([root(i) for i in range(n)]))


def first_seen(labels: np.ndarray) -> np.ndarray:
    """Relabel 0.. by order of first appearance."""
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(v), len(seen)) for v in labels], dtype=int)


def build_gain(block: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """Total distance to the nearest medoid if each row of ``block`` joined them."""
    return np.minimum(block, nearest[None, :]).sum(axis=1)


def swap_deltas(block: np.ndarray, nearest: np.ndarray, second: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Change of total distance for every (candidate row, medoid removed)."""
    joined = np.minimum(block - nearest[None, :], 0.0)
    lost = np.minimum(block, second[None, :]) - nearest[None, :] - joined
    return joined.sum(axis=1)[:, None] + lost @ np.eye(k)[owner]


def medoid_view(to_medoids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest distance, second-nearest distance and nearest medoid of every point."""
    order = np.argsort(to_medoids, axis=1, kind="stable")
    rows = np.arange(len(to_medoids))
    second = to_medoids[rows, order[:, 1]] if to_medoids.shape[1] > 1 else np.full(len(to_medoids), np.inf)
    return to_medoids[rows, order[:, 0]], second, order[:, 0]


def pam_medoids(d: np.ndarray, k: int) -> list[int]:
    """Medoids of a full distance matrix: greedy build, then best swaps until none helps."""
    medoids: list[int] = []
    nearest = np.full(len(d), np.inf)
    for _ in range(k):
        gain = build_gain(d, nearest)
        gain[medoids] = np.inf
        medoids.append(int(np.argmin(gain)))
        nearest = np.minimum(nearest, d[medoids[-1]])
    while True:
        delta = swap_deltas(d, *medoid_view(d[:, medoids]), k)
        delta[medoids] = np.inf
        c, i = divmod(int(np.argmin(delta)), k)
        if delta[c, i] >= -1e-9:
            return medoids
        medoids[i] = c


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, max_iter: int = 100) -> np.ndarray:
    """k-means labels from one spread-out random start."""
    centres = [x[rng.integers(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = gap.sum()
        pick = rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))
        centres.append(x[pick])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    labels = None
    for _ in range(max_iter):
        new = distances(x, c).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                c[j] = x[labels == j].mean(axis=0)
    return labels


def clara_labels(x: np.ndarray, k: int, rng: np.random.Generator, samples: int = 5) -> np.ndarray:
    """Best of several sampled k-medoid fits."""
    best, out = np.inf, None
    for _ in range(samples):
        rows = rng.choice(len(x), min(len(x), 40 + 2 * k), replace=False)
        sub = x[rows]
        near = distances(x, sub[pam_medoids(distances(sub, sub), k)])
        cost = near.min(axis=1).sum()
        if cost < best:
            best, out = cost, near.argmin(axis=1)
    return out


def cluster_labels(method: str, x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    if method == "hierarchical":
        return cut_merges(len(x), ward_merges(x, np.ones(len(x))), k)
    if method == "kmeans":
        return first_seen(lloyd(x, k, rng))
    if method == "pam":
        d = distances(x, x)
        return first_seen(d[:, pam_medoids(d, k)].argmin(axis=1))
    if method == "clara":
        return first_seen(clara_labels(x, k, rng))
    raise ValueError(f"unknown method {method}")
