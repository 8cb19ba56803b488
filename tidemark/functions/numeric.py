"""Numerical parts that several detectors share: peaks, assignment, clustering, mixtures, precision matrices."""

from __future__ import annotations

import math

import numpy as np


def prominences(y: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points on either side, up to the next higher value or the end."""
    out = np.empty(len(peaks))
    for i, p in enumerate(peaks):
        left = np.flatnonzero(y[:p] > y[p])
        right = np.flatnonzero(y[p + 1 :] > y[p])
        a = left[-1] + 1 if len(left) else 0
        b = p + 1 + right[0] if len(right) else len(y)
        out[i] = y[p] - max(y[a : p + 1].min(), y[p:b].min())
    return out


def find_peaks(y: np.ndarray, distance: int = 1) -> np.ndarray:
    """Interior local maxima (a plateau counts at its middle), the higher of two nearer than `distance` being kept."""
    found, i = [], 1
    while i < len(y) - 1:
        if y[i] > y[i - 1]:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-y[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return np.array(sorted(kept), int)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths; the smaller side is matched whole."""
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def complete_linkage(points: np.ndarray, limit: float) -> np.ndarray:
    """Clusters by merging the pair whose farthest members are nearest (Manhattan), while that is within the limit."""
    groups = [[i] for i in range(len(points))]
    far = np.abs(points[:, None] - points[None]).sum(-1).astype(float)
    np.fill_diagonal(far, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(np.argmin(far)), len(far))
        if far[i, j] > limit:
            break
        i, j = sorted((i, j))
        groups[i] += groups.pop(j)
        row = np.maximum(far[i], far[j])
        far[i], far[:, i] = row, row
        far[i, i] = np.inf
        far = np.delete(np.delete(far, j, 0), j, 1)
    out = np.empty(len(points), int)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def by_first_seen(labels: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in the order in which they first occur."""
    values, first, back = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(values), int)
    rank[np.argsort(first)] = np.arange(len(values))
    return rank[back.ravel()]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    centres = np.array(centres, float)
    for _ in range(rounds):
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return label, centres


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = np.unique(label)
    if len(groups) < 2:
        return -1.0
    mean = np.stack([far[:, label == g].sum(1) / max(1, (label == g).sum()) for g in groups], 1)
    own = np.searchsorted(groups, label)
    size = np.array([(label == g).sum() for g in groups])[own]
    a = mean[np.arange(len(x)), own] * size / np.maximum(size - 1, 1)
    mean[np.arange(len(x)), own] = np.inf
    b = mean.min(1)
    return float(np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def dirichlet_mixture(x: np.ndarray, k: int, alpha: float, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Labels from a variational mixture of diagonal Gaussians with a stick-breaking prior of concentration alpha."""
    n, d = x.shape
    k = min(k, n)
    x = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    label, _ = kmeans(x, k, rng)
    r = np.eye(k)[label] * 0.9 + 0.1 / k
    for _ in range(rounds):
        size = r.sum(0) + 1e-9
        mean = (r.T @ x) / size[:, None]
        var = (r.T @ x**2) / size[:, None] - mean**2
        var = (size[:, None] * np.maximum(var, 0) + 1.0) / (size[:, None] + 1.0) * 1.0 + 1e-6
        tail = np.concatenate([np.cumsum(size[::-1])[::-1][1:], [0.0]])
        a, b = 1 + size, alpha / k + tail
        stick = digamma(a) - digamma(a + b)
        rest = np.concatenate([[0], np.cumsum((digamma(b) - digamma(a + b))[:-1])])
        log = stick + rest - 0.5 * (np.log(2 * math.pi * var).sum(1) + ((x[:, None] - mean) ** 2 / var).sum(-1))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - r).max() < 1e-4:
            break
        r = new
    return by_first_seen(r.argmax(1))


def graphical_lasso(s: np.ndarray, penalty: np.ndarray | float, rounds: int = 200, rho: float = 1.0, tie=None) -> np.ndarray:
    """Sparse precision matrix by ADMM; `tie` averages entries that must be equal before they shrink."""
    d = len(s)
    z, u = np.eye(d), np.zeros((d, d))
    for _ in range(rounds):
        value, vector = np.linalg.eigh(rho * (z - u) - s)
        theta = (vector * ((value + np.sqrt(value**2 + 4 * rho)) / (2 * rho))) @ vector.T
        a = theta + u
        if tie is not None:
            a = tie(a)
        new = np.sign(a) * np.maximum(np.abs(a) - penalty / rho, 0)
        u = u + theta - new
        if np.abs(new - z).max() < 1e-4 and np.abs(theta - new).max() < 1e-4:
            return new
        z = new
    return z


def viterbi(log_start: np.ndarray, log_move: np.ndarray, log_emit: np.ndarray) -> np.ndarray:
    """The likeliest state sequence; of equals the lowest state."""
    n, k = log_emit.shape
    score, back = log_start + log_emit[0], np.zeros((n, k), int)
    for t in range(1, n):
        all_ = score[:, None] + log_move
        back[t] = all_.argmax(0)
        score = all_.max(0) + log_emit[t]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def switching_path(cost: np.ndarray, penalty: float) -> np.ndarray:
    """The path of least cost through cost[t, state] when each change of state costs `penalty`."""
    n, k = cost.shape
    ahead, step = np.zeros(k), np.zeros((n, k), int)
    for t in range(n - 2, -1, -1):
        later = ahead + cost[t + 1]
        best = int(later.argmin())
        stay = later <= later[best] + penalty
        step[t] = np.where(stay, np.arange(k), best)
        ahead = np.where(stay, later, later[best] + penalty)
    path = np.empty(n, int)
    path[0] = int((ahead + cost[0]).argmin())
    for t in range(n - 1):
        path[t + 1] = step[t, path[t]]
    return path


def majority_vote(labels: np.ndarray, n: int, width: int, step: int) -> np.ndarray:
    """Label of each time step: the most frequent among the windows that cover it, the smallest of equals, 0 where none does."""
    votes = np.zeros((n, int(labels.max()) + 1 if len(labels) else 1), int)
    for i, label in enumerate(labels):
        votes[i * step : i * step + width, label] += 1
    return votes.argmax(1)


def segments_of(cps: list[int], n: int) -> list[tuple[int, int]]:
    edges = [0, *sorted({c for c in cps if 0 < c < n}), n]
    return list(zip(edges, edges[1:], strict=False))


def labels_of(cps: list[int], n: int) -> np.ndarray:
    out = np.zeros(n, int)
    for c in {c for c in cps if 0 < c < n}:
        out[c:] += 1
    return out


def change_points_of(labels: np.ndarray) -> list[int]:
    return (np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist()


def aggregate_change_points(cps: list[int], n_cps: int, tolerance: float, n: int) -> list[int]:
    """Votes of several channels: the most frequent points, or with a tolerance chains of near ones by size, at their medians."""
    points = sorted(cps)
    reach = int(tolerance * n) if isinstance(tolerance, float) and tolerance < 1 else int(tolerance)
    groups: list[list[int]] = []
    for p in points:
        if groups and (p - groups[-1][-1] <= reach if reach else p == groups[-1][-1]):
            groups[-1].append(p)
        else:
            groups.append([p])
    groups.sort(key=lambda g: -len(g))
    return sorted({int(np.median(g)) for g in groups[:n_cps]})


def spread(x: np.ndarray) -> np.ndarray:
    """Channels on [0, 1]; a constant one is 0."""
    low, high = x.min(0), x.max(0)
    return np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0.0)


def zscore(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd < 1e-8, 1, sd)


def windows_of(x: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """(windows, width, channels)"""
    view = np.lib.stride_tricks.sliding_window_view(x, width, axis=0)[::step]
    return np.ascontiguousarray(view.transpose(0, 2, 1))
