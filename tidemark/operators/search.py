"""Detectors that search for the segmentation of least cost."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import costs as C
from .base import MAX_PAIRS_POINTS, Detector
from .params import Callable_, DataBound, Options, Param, Rule, exclusive, integer, real

MODEL = Param("model", (Options(tuple(C.COSTS)), Callable_()))


@dataclass
class AmocDetector(Detector):
    """At most one change: the split of least squared error."""

    min_size: int = 5
    PARAMS = (integer("min_size"),)

    def kernel(self, x):
        n = len(x)
        if n < 2 * self.min_size:
            return []
        cost, _ = C.cost_of("l2", x)
        t = np.arange(self.min_size, n - self.min_size + 1)
        return [int(t[np.argmin(cost(np.zeros_like(t), t) + cost(t, np.full_like(t, n)))])]


@dataclass
class BinSegDetector(Detector):
    n_cps: int | None = None
    model: object = "l2"
    min_size: int = 2
    jump: int = 5
    penalty: float | None = 10.0
    epsilon: float | None = None
    cost_params: dict | None = None
    PARAMS = (integer("n_cps", nullable=True), MODEL, integer("min_size"), integer("jump"), real("penalty", nullable=True), real("epsilon", nullable=True), Rule(lambda o: any(v is not None for v in (o.n_cps, o.penalty, o.epsilon)), "one of n_cps, penalty and epsilon is needed"))
    search = staticmethod(C.binary_segmentation)

    def kernel(self, x):
        cost, least = C.cost_of(self.model, x, self.cost_params)
        return self.search(cost, len(x), max(self.min_size, least), self.jump, self.n_cps, self.penalty, self.epsilon)


@dataclass
class BottomUpDetector(BinSegDetector):
    search = staticmethod(C.bottom_up)


@dataclass
class DynpDetector(Detector):
    """The optimum for a fixed number of change points."""

    n_cps: int = 1
    model: object = "l2"
    min_size: int = 2
    jump: int = 5
    cost_params: dict | None = None
    max_points: int | None = 100_000
    PARAMS = (integer("n_cps"), MODEL, integer("min_size"), integer("jump"))

    def kernel(self, x):
        cost, least = C.cost_of(self.model, x, self.cost_params)
        least = max(self.min_size, least)
        return C.dynamic_program(cost, len(x), least, self.jump, self.n_cps) if len(x) >= least * (self.n_cps + 1) else []


@dataclass
class PeltDetector(Detector):
    model: object = "l2"
    min_size: int = 2
    jump: int = 5
    penalty: float = 10.0
    cost_params: dict | None = None
    PARAMS = (MODEL, integer("min_size"), integer("jump"), real("penalty"))

    def kernel(self, x):
        cost, least = C.cost_of(self.model, x, self.cost_params)
        return C.pelt(cost, len(x), max(self.min_size, least), self.jump, self.penalty)


@dataclass
class KCPDDetector(Detector):
    """Kernel change points: the exact number if n_cps is given, else the penalised optimum."""

    n_cps: int | None = None
    pen: float | None = 10.0
    kernel_name: str = "rbf"
    min_size: int = 2
    jump: int = 1
    cost_params: dict | None = None
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (integer("n_cps", nullable=True), real("pen", nullable=True), Param("kernel_name", (Options(("linear", "rbf", "cosine")),)), integer("min_size"), integer("jump"), Rule(lambda o: o.n_cps is not None or o.pen is not None, "one of n_cps and pen is needed"))

    def kernel(self, x):
        cost, least = C.cost_of("l2" if self.kernel_name == "linear" else self.kernel_name, x, self.cost_params)
        least = max(self.min_size, least)
        if self.n_cps is not None:
            return C.dynamic_program(cost, len(x), least, self.jump, self.n_cps) if C.feasible(len(x), self.n_cps, self.jump, least) else []
        return C.pelt(cost, len(x), least, self.jump, self.pen)


@dataclass
class WindowDetector(Detector):
    width: int = 100
    n_cps: int | None = None
    pen: float | None = None
    epsilon: float | None = None
    model: object = "l2"
    min_size: int = 2
    jump: int = 5
    cost_params: dict | None = None
    PARAMS = (integer("width", 2), integer("n_cps", nullable=True), real("pen", nullable=True), real("epsilon", nullable=True), MODEL, integer("min_size"), integer("jump"), exclusive("n_cps", "pen", "epsilon"), Rule(lambda o: any(v is not None for v in (o.n_cps, o.pen, o.epsilon)), "one of n_cps, pen and epsilon is needed"), DataBound("width", lambda n, d: n, "the number of points"))

    def kernel(self, x):
        cost, least = C.cost_of(self.model, x, self.cost_params)
        return C.window_search(cost, len(x), self.width, max(self.min_size, least), self.jump, self.n_cps, self.pen, self.epsilon)


def shannon(mass: np.ndarray) -> np.ndarray:
    """Entropy of channel sums along the last axis."""
    total = mass.sum(-1, keepdims=True)
    p = np.divide(mass, total, out=np.zeros_like(mass), where=total > 0)
    return -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(-1)


def with_complement(x: np.ndarray) -> np.ndarray:
    """Channels as distributions over time, and for each its mirror image."""
    y = x - x.min(0)
    total = y.sum(0)
    y = np.divide(y, total, out=np.zeros_like(y), where=total > 0)
    return np.hstack([y, y.max(0) - y])


def information_gain(sums: np.ndarray, cps: list[int]) -> float:
    n = len(sums) - 1
    edges = np.array([0, *sorted(cps), n])
    mass, size = np.diff(sums[edges], axis=0), np.diff(edges)
    return float(shannon(sums[-1]) - (size / n * shannon(mass)).sum())


@dataclass
class InformationGainDetector(Detector):
    """Greedy change points of the highest Shannon information gain."""

    k_max: int = 10
    step: int = 5
    PARAMS = (integer("k_max"), integer("step"))

    def trace(self, x: np.ndarray) -> list[tuple[int, int, float]]:
        """(round, point, gain) in the order of choice."""
        y = with_complement(x)
        sums = np.concatenate([np.zeros((1, y.shape[1])), y.cumsum(0)])
        found: list[int] = []
        out = []
        for k in range(self.k_max):
            grid = np.setdiff1d(np.arange(0, len(x), self.step), found)
            if not len(grid):
                break
            edges = np.array([0, *sorted(found), len(x)])
            piece = np.searchsorted(edges, grid, side="right") - 1
            s, e = edges[piece], edges[piece + 1]
            loss = lambda a, b: (b - a) / len(x) * shannon(sums[b] - sums[a])
            gain = information_gain(sums, found) + loss(s, e) - loss(s, grid) - loss(grid, e)
            i = int(np.argmax(gain))
            found.append(int(grid[i]))
            out.append((k + 1, found[-1], float(gain[i])))
        return out

    def kernel(self, x):
        return [c for _, c, _ in self.trace(x)]


@dataclass
class GreedyGaussianDetector(Detector):
    """Greedy splits of the regularised Gaussian likelihood, each followed by passes that move points; the states are the segments."""

    dense = True
    k_max: int = 10
    lamb: float = 1.0
    max_shuffles: int = 250
    random_state: int | None = None
    PARAMS = (integer("k_max"), real("lamb"), integer("max_shuffles", 0), integer("random_state", None, nullable=True))

    def kernel(self, x):
        n, d = x.shape
        first = np.concatenate([np.zeros((1, d)), x.cumsum(0)])
        second = np.concatenate([np.zeros((1, d, d)), (x[:, :, None] * x[:, None, :]).cumsum(0)])

        def price(s, e):
            m = np.asarray(e - s, float)[:, None, None]
            mean = (first[e] - first[s]) / m[:, :, 0]
            cov = (second[e] - second[s]) / m - mean[:, :, None] * mean[:, None, :] + self.lamb / m * np.eye(d)
            return m[:, 0, 0] * np.linalg.slogdet(cov)[1] - self.lamb * np.trace(np.linalg.inv(cov), axis1=1, axis2=2)

        def best(s, e):
            if e - s < 2:
                return None, 0.0
            t = np.arange(s + 1, e)
            low = price(np.full_like(t, s), t) + price(t, np.full_like(t, e))
            i = int(np.argmin(low))
            return int(t[i]), float(price(np.array([s]), np.array([e]))[0] - low[i])

        rng = np.random.default_rng(self.random_state)
        edges, known = [0, n], {}
        while len(edges) - 2 < self.k_max:
            for pair in zip(edges, edges[1:], strict=False):
                if pair not in known:
                    known[pair] = best(*pair)
            t, gain = max((known[p] for p in zip(edges, edges[1:], strict=False)), key=lambda v: v[1])
            if t is None or gain <= 0:
                break
            edges = sorted([*edges, t])
            moved = set(edges)
            for _ in range(self.max_shuffles):
                order, now = rng.permutation(np.arange(1, len(edges) - 1)), set()
                for i in order:
                    if {edges[i - 1], edges[i], edges[i + 1]} & moved:
                        t, _ = best(edges[i - 1], edges[i + 1])
                        if t != edges[i]:
                            edges[i] = t
                            now.add(t)
                if not now:
                    break
                moved = now
        out = np.zeros(n, int)
        for e in edges[1:-1]:
            out[e:] += 1
        return out


@dataclass
class EAggloDetector(Detector):
    """Adjacent clusters agglomerated by energy distance; of all stages the one of the best goodness of fit."""

    dense = True
    member: object = None
    alpha: float = 1.0
    penalty: object = None
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (real("alpha", 0, 2, "right"), Param("penalty", (Options(("len_penalty", "mean_diff_penalty")), Callable_()), True))

    def kernel(self, x):
        n = len(x)
        member = np.arange(n) if self.member is None else np.asarray(self.member)
        edges = [0, *(np.flatnonzero(np.diff(member)) + 1).tolist(), n]
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** self.alpha
        starts = np.array(edges[:-1])
        size = np.diff(edges).astype(float)
        between = np.add.reduceat(np.add.reduceat(far, starts, 0), starts, 1) / np.outer(size, size)
        within = np.diag(between).copy()
        energy = 2 * between - within[:, None] - within[None]
        np.fill_diagonal(energy, 0)
        k = len(starts)
        alive, nxt, prv = np.ones(k, bool), [(i + 1) % k for i in range(k)], [(i - 1) % k for i in range(k)]
        group = np.repeat(np.arange(k), np.diff(edges))
        term = lambda i, j: 2 * size[i] * size[j] / (size[i] + size[j]) * energy[i, j]
        fit = sum(term(i, nxt[i]) for i in range(k)) if k > 1 else 0.0
        stages = [(fit, group.copy())]
        for _ in range(k - 1):
            ids = np.flatnonzero(alive)
            best = (-np.inf, None)
            for i in ids:
                j = nxt[i]
                a, b = prv[i], nxt[j]
                if len(ids) == 2:
                    new = 0.0
                else:
                    m = size[i] + size[j]
                    joined = lambda o: ((size[i] + size[o]) * energy[i, o] + (size[j] + size[o]) * energy[j, o] - size[o] * energy[i, j]) / (m + size[o])  # noqa: B023, E731
                    side = lambda o: 2 * m * size[o] / (m + size[o]) * joined(o)  # noqa: B023, E731
                    new = fit - term(a, i) - term(i, j) - term(j, b) + side(a) + side(b)
                if new > best[0]:
                    best = (new, i)
            fit, i = best
            j = nxt[i]
            m = size[i] + size[j]
            row = ((size[i] + size) * energy[i] + (size[j] + size) * energy[j] - size * energy[i, j]) / (m + size)
            energy[i], energy[:, i] = row, row
            energy[i, i], size[i], alive[j] = 0, m, False
            nxt[i], prv[nxt[j]] = nxt[j], i
            group[group == j] = i
            stages.append((fit, group.copy()))
        scores = [f + self._penalty(x, g) for f, g in stages]
        out = stages[int(np.argmax(scores))][1]
        return np.unique(out, return_inverse=True)[1]

    def _penalty(self, x, group):
        cps = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(x)]
        if self.penalty is None:
            return 0.0
        if self.penalty == "len_penalty":
            return -len(cps)
        if self.penalty == "mean_diff_penalty":
            return float(np.mean(np.sort(np.diff(cps))))
        return float(self.penalty(cps))
