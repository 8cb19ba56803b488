"""Costs of segments [s, e) of a series (n, d), as functions of arrays of ends, and the search procedures over them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np

Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]


class NotEnoughPoints(ValueError):
    """A segment is shorter than its cost can judge."""


class BadSegmentationParameters(ValueError):
    """The series is too short for the segmentation asked for."""


def _prefix(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])


def _l2(x: np.ndarray) -> Cost:
    first, second = _prefix(x - x.mean(0)), _prefix(((x - x.mean(0)) ** 2).sum(1))
    return lambda s, e: second[e] - second[s] - ((first[e] - first[s]) ** 2).sum(-1) / np.maximum(e - s, 1)


def _each(one: Callable[[int, int], float]) -> Cost:
    """Costs without a closed form, one segment at a time, each once."""
    known: dict[tuple[int, int], float] = {}

    def all_(s, e):
        s, e = np.broadcast_arrays(s, e)
        out = np.empty(s.shape)
        for i in np.ndindex(s.shape):
            key = (int(s[i]), int(e[i]))
            if key not in known:
                known[key] = one(*key)
            out[i] = known[key]
        return out

    return all_


def _l1(x: np.ndarray) -> Cost:
    return _each(lambda s, e: float(np.abs(x[s:e] - np.median(x[s:e], axis=0)).sum()))


def _normal(x: np.ndarray) -> Cost:
    n, d = x.shape
    if d == 1:
        first, second = _prefix(x[:, 0] - x.mean()), _prefix((x[:, 0] - x.mean()) ** 2)

        def one(s, e):
            m = e - s
            return m * np.log(np.maximum((second[e] - second[s]) / m - ((first[e] - first[s]) / m) ** 2, 0) + 1e-6)

        return one
    return _each(lambda s, e: (e - s) * float(np.linalg.slogdet(np.cov(x[s:e].T) + 1e-6 * np.eye(d))[1]))


def _linear(x: np.ndarray) -> Cost:
    def one(s: int, e: int) -> float:
        residual = np.linalg.lstsq(x[s:e, 1:], x[s:e, 0], rcond=None)[1]
        return float(residual[0]) if len(residual) else 0.0

    return _each(one)


def _kernel(gram: np.ndarray) -> Cost:
    total = np.zeros((len(gram) + 1, len(gram) + 1))
    total[1:, 1:] = gram.cumsum(0).cumsum(1)
    trace = _prefix(np.diag(gram))
    return lambda s, e: trace[e] - trace[s] - (total[e, e] - total[s, e] - total[e, s] + total[s, s]) / np.maximum(e - s, 1)


def _rbf(x: np.ndarray, gamma: float | None = None) -> Cost:
    squares = ((x[:, None] - x[None]) ** 2).sum(-1)
    if gamma is None:
        some = squares[np.triu_indices(len(x), 1)]
        middle = np.median(some[some > 0]) if (some > 0).any() else 1.0
        gamma = 1 / middle
    return _kernel(np.exp(-np.clip(gamma * squares, 1e-2, 1e2)))


def _cosine(x: np.ndarray) -> Cost:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x, float), where=size > 0)
    return _kernel(unit @ unit.T)


COSTS: dict[str, tuple[Callable, int]] = {"l2": (_l2, 1), "l1": (_l1, 2), "normal": (_normal, 2), "linear": (_linear, 2), "rbf": (_rbf, 1), "cosine": (_cosine, 1)}


def cost_of(model, x: np.ndarray, cost_params: dict | None = None) -> tuple[Cost, int]:
    """A model's cost on x and the shortest segment it can judge. A callable is a cost of the user's own: f(x) -> f(s, e)."""
    if callable(model):
        own = model(x, **(cost_params or {}))
        return _each(lambda s, e: float(own(s, e))), getattr(model, "min_size", 1)
    if model not in COSTS:
        raise ValueError(f"cost {model!r} is none of {sorted(COSTS)}")
    make, least = COSTS[model]
    return make(x, **(cost_params or {})), least


def feasible(n: int, n_cps: int, jump: int, min_size: int) -> bool:
    return n_cps <= n // jump and n_cps * math.ceil(min_size / jump) * jump + min_size <= n


def _goes_on(n_found: int, gain: float, total: float, n_cps, penalty, epsilon) -> bool:
    if n_cps is not None:
        return n_found < n_cps
    return gain > penalty if epsilon is None else total > epsilon


def binary_segmentation(cost: Cost, n: int, min_size: int, jump: int, n_cps=None, penalty=None, epsilon=None) -> list[int]:
    """Greedy splits; of equal gains the last point of a segment, of equal segments the first."""

    def best(s: int, e: int):
        b = np.arange(s, e, jump)
        b = b[(b - s >= min_size) & (e - b >= min_size)]
        if not len(b):
            return 0.0, None
        gains = cost(np.full_like(b, s), np.full_like(b, e)) - cost(np.full_like(b, s), b) - cost(b, np.full_like(b, e))
        i = len(b) - 1 - int(np.argmax(gains[::-1]))
        return float(gains[i]), int(b[i])

    segments, found = {(0, n): best(0, n)}, []
    while segments:
        (s, e), (gain, b) = max(((k, segments[k]) for k in sorted(segments)), key=lambda kv: kv[1][0])
        total = float(sum(cost(np.array([p]), np.array([q]))[0] for p, q in segments)) if epsilon is not None else 0.0
        if b is None or not _goes_on(len(found), gain, total, n_cps, penalty, epsilon):
            break
        del segments[s, e]
        segments[s, b], segments[b, e] = best(s, b), best(b, e)
        found.append(b)
    return sorted(found)


def bottom_up(cost: Cost, n: int, min_size: int, jump: int, n_cps=None, penalty=None, epsilon=None) -> list[int]:
    """Splits the longest segment near its middle while it can, then merges the pair that costs least."""
    heap, leaves = [(-n, 0, n)], []
    while heap:
        _, s, e = heapq.heappop(heap)
        grid = [b for b in range(jump * (s // jump), e, jump) if b - s >= min_size and e - b >= min_size]
        if not grid:
            leaves = [(s, e), *((a, b) for _, a, b in heap)]
            break
        middle = (s + e) * 0.5
        b = min(grid, key=lambda v: abs(v - middle))
        heapq.heappush(heap, (-(b - s), s, b))
        heapq.heappush(heap, (-(e - b), b, e))
    leaves.sort()
    price = lambda s, e: float(cost(np.array([s]), np.array([e]))[0])
    values = [price(*leaf) for leaf in leaves]
    while len(leaves) > 1:
        joined = [price(a[0], b[1]) for a, b in zip(leaves, leaves[1:], strict=False)]
        gains = [j - p - q for j, p, q in zip(joined, values, values[1:], strict=False)]
        i = int(np.argmin(gains))
        if n_cps is not None:
            more = len(leaves) > n_cps + 1
        else:
            more = gains[i] < penalty if epsilon is None else sum(values) < epsilon
        if not more:
            break
        leaves[i : i + 2], values[i : i + 2] = [(leaves[i][0], leaves[i + 1][1])], [joined[i]]
    return [s for s, _ in leaves[1:]]


def dynamic_program(cost: Cost, n: int, min_size: int, jump: int, n_cps: int) -> list[int]:
    """The best segmentation with n_cps change points on the grid."""
    if not feasible(n, n_cps, jump, min_size):
        raise BadSegmentationParameters(f"{n} points can't hold {n_cps} change points")
    ends = np.array([*range(jump, n, jump), n])
    value = np.where(ends >= min_size, cost(np.zeros_like(ends), ends), np.inf)
    back = []
    for k in range(1, n_cps + 1):
        new, choice = np.full(len(ends), np.inf), np.zeros(len(ends), int)
        for j, e in enumerate(ends):
            b = np.flatnonzero((ends[:j] % jump == 0) & (e - ends[:j] >= min_size) & np.array([feasible(int(q), k - 1, jump, min_size) for q in ends[:j]], bool)) if j else np.empty(0, int)
            if len(b):
                total = value[b] + cost(ends[b], np.full(len(b), e))
                i = int(np.argmin(total))
                new[j], choice[j] = total[i], b[i]
        value = new
        back.append(choice)
    out, j = [], len(ends) - 1
    if not np.isfinite(value[-1]):
        raise BadSegmentationParameters("no feasible segmentation")
    for choice in reversed(back):
        j = choice[j]
        out.append(int(ends[j]))
    return sorted(out)


def pelt(cost: Cost, n: int, min_size: int, jump: int, penalty: float) -> list[int]:
    """The penalised optimum; a start is dropped once it can't be best for any later end."""
    ends = [e for e in range(0, n, jump) if e >= min_size] + [n]
    best, last, open_ = {0: 0.0}, {}, []
    for e in ends:
        new = (e - min_size) // jump * jump
        if new not in open_ and (new == 0 or new in best):
            open_.append(new)
        starts = np.array([t for t in open_ if t in best and e - t >= min_size])
        if not len(starts):
            continue
        total = np.array([best[t] for t in starts]) + cost(starts, np.full(len(starts), e)) + penalty
        i = int(np.argmin(total))
        best[e], last[e] = float(total[i]), int(starts[i])
        gone = set(starts[total > best[e] + penalty].tolist())
        open_ = [t for t in open_ if t not in gone]
    out, e = [], n
    while e in last and last[e] > 0:
        e = last[e]
        out.append(e)
    return sorted(out)


def local_maxima(y: np.ndarray, order: int) -> np.ndarray:
    """Positions strictly above all others within `order`; missing neighbours at the edges don't count."""
    out = np.ones(len(y), bool)
    for k in range(1, min(order, max(len(y) - 1, 0)) + 1):
        out[k:] &= y[k:] > y[:-k]
        out[:-k] &= y[:-k] > y[k:]
    return np.flatnonzero(out)


def sliding_gain(cost: Cost, n: int, width: int, jump: int) -> tuple[np.ndarray, np.ndarray]:
    half = width // 2
    c = np.arange(0, n, jump)
    c = c[(c >= half) & (c < n - half)]
    return c, cost(c - half, c + half) - cost(c - half, c) - cost(c, c + half)


def window_search(cost: Cost, n: int, width: int, min_size: int, jump: int, n_cps=None, penalty=None, epsilon=None) -> list[int]:
    width += width % 2
    centres, gains = sliding_gain(cost, n, width, jump)
    if not len(centres):
        return []
    peaks = local_maxima(gains, max(max(width, 2 * min_size) // (2 * jump), 1))
    found: list[int] = []
    for i in sorted(peaks, key=lambda i: (-gains[i], -i)):
        edges = [0, *sorted(found), n]
        total = float(cost(np.array(edges[:-1]), np.array(edges[1:])).sum())
        if not _goes_on(len(found), float(gains[i]), total, n_cps, penalty, epsilon):
            break
        found.append(int(centres[i]))
    return sorted(found)
