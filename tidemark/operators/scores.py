"""Detectors that score every point and pick peaks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

from ..functions import windowing as W
from ..functions.costs import local_maxima
from ..functions.numeric import find_peaks, graphical_lasso, prominences, spread, windows_of, zscore
from .base import MAX_PAIRS_POINTS, Detector, channels
from .params import Callable_, Options, Param, Rule, choice, exclusive, integer, real
from .search import information_gain, with_complement

STRATEGY = choice("multivariate_strategy", "l2", "ensembling")


def apart(order: np.ndarray, distance: int, most: int | None = None) -> list[int]:
    """Points in the order given, each at least `distance` from those taken before."""
    out: list[int] = []
    for p in order:
        if most is not None and len(out) >= most:
            break
        if all(abs(int(p) - q) >= distance for q in out):
            out.append(int(p))
    return out


def log_sum(a: np.ndarray) -> float:
    top = a.max() if len(a) else -np.inf
    return float(top + np.log(np.exp(a - top).sum())) if np.isfinite(top) else -np.inf


@dataclass
class BOCDDetector(Detector):
    """Offline posterior of change points under a Normal-Gamma model of segments and a constant hazard."""

    hazard_lambda: float = 300.0
    mu: float = 0.0
    kappa: float = 1.0
    alpha: float = 1.0
    beta: float = 1.0
    truncate: float = -40.0
    cp_prob_threshold: float = 0.05
    min_distance: int = 25
    max_cps: int | None = None
    multivariate_strategy: str = "l2"
    tolerance: float = 0
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (real("hazard_lambda", 1), real("kappa", 0, None, "right"), real("alpha", 0, None, "neither"), real("beta", 0, None, "neither"), real("truncate", None, 0), real("cp_prob_threshold", 0, 1), integer("min_distance"), integer("max_cps", nullable=True), STRATEGY, real("tolerance", 0))

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Log marginal of x[t..s] for all t <= s."""
        n = len(x)
        gamma = np.array([math.lgamma(self.alpha + m / 2) for m in range(n + 1)])
        first, second = np.cumsum(np.append(0, x)), np.cumsum(np.append(0, x * x))
        t, s = np.triu_indices(n)
        m = s - t + 1
        total = first[s + 1] - first[t]
        mean = total / m
        squares = np.maximum(second[s + 1] - second[t] - total * mean, 0)
        k = self.kappa + m
        b = self.beta + 0.5 * squares + self.kappa * m * (mean - self.mu) ** 2 / (2 * k)
        out = np.full((n, n), -np.inf)
        out[t, s] = gamma[m] - math.lgamma(self.alpha) + self.alpha * math.log(self.beta) - (self.alpha + m / 2) * np.log(b) + 0.5 * (math.log(self.kappa) - np.log(k)) - m / 2 * math.log(math.pi)
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Probability that a segment ends at each point, scaled to sum 1."""
        n, p = len(x), self.marginals(x)
        g = -math.log(self.hazard_lambda)
        mass = np.log(np.arange(1, n + 1)) + g
        tail = np.where(mass < 0, np.log1p(-np.exp(np.minimum(mass, -1e-12))), -np.inf)
        q = np.full(n + 1, -np.inf)
        q[n] = 0
        for t in range(n - 1, -1, -1):
            terms = p[t, t : n - 1] + q[t + 1 : n] + g
            if len(terms):
                running = np.logaddexp.accumulate(terms)
                small = np.flatnonzero(terms - running < self.truncate)
                terms = terms[: small[0] + 1] if len(small) else terms
            q[t] = np.logaddexp(log_sum(terms), p[t, n - 1] + tail[n - 1 - t])
        cp = p[0, : n - 1] + q[1:n] + g - q[0]
        total = np.exp(cp)
        for j in range(1, n - 1):
            new = np.full(n - 1, -np.inf)
            for t in range(j, n - 1):
                new[t] = log_sum(cp[j - 1 : t] + p[j : t + 1, t] + q[t + 1] + g - q[j : t + 1])
            if not np.isfinite(new).any() or new.max() < -20:
                break
            cp = new
            total += np.exp(cp)
        return total / total.sum() if total.sum() > 0 else total

    def one(self, x: np.ndarray) -> list[int]:
        if len(x) < 3:
            return []
        prob = self.posterior(x)
        order = [i for i in np.argsort(-prob, kind="stable") if prob[i] >= self.cp_prob_threshold]
        inner = [i + 1 for i in order if self.min_distance <= i + 1 <= len(x) - self.min_distance]
        return apart(np.array(inner, int), self.min_distance, self.max_cps)

    def kernel(self, x):
        return channels(x, self.multivariate_strategy, self.one, self.tolerance)


class Sdar:
    """Sequentially discounting autoregression of one channel: learns and scores a value at a time."""

    def __init__(self, order: int, discount: float):
        self.order, self.discount = order, discount
        self.mean, self.sigma, self.cov, self.past = 0.0, 1.0, np.zeros(order + 1), []

    def warm_up(self, x: np.ndarray) -> None:
        """Starts from the plain moments of some values (Yule-Walker)."""
        y = x - x.mean()
        self.mean = float(x.mean())
        self.cov = np.array([float((y[j:] * y[: len(y) - j]).mean()) if len(y) > j else 0.0 for j in range(self.order + 1)])
        self.sigma = max(float(self.cov[0] - self._weights() @ self.cov[1:]), 1e-10)
        self.past = list(x[-self.order :])

    def _weights(self) -> np.ndarray:
        c = self.cov
        k = self.order
        table = c[np.abs(np.arange(k)[:, None] - np.arange(k)[None])] + 1e-10 * max(abs(c[0]), 1e-10) * np.eye(k)
        return np.linalg.solve(table, c[1:])

    def update(self, value: float, kind: str = "logarithmic") -> float:
        past, r = np.array(self.past[::-1]), self.discount
        guess = self.mean + (float(self._weights()[: len(past)] @ (past - self.mean)) if len(past) else 0.0)
        self.mean = (1 - r) * self.mean + r * value
        for j in range(self.order + 1):
            if j == 0 or j <= len(past):
                other = value if j == 0 else past[j - 1]
                self.cov[j] = (1 - r) * self.cov[j] + r * (value - self.mean) * (other - self.mean)
        error = (value - guess) ** 2
        self.sigma = max((1 - r) * self.sigma + r * error, 1e-10)
        self.past = [*self.past, value][-self.order :]
        return error if kind == "quadratic" else 0.5 * math.log(2 * math.pi * self.sigma) + error / (2 * self.sigma)

    def many(self, values: np.ndarray, block: int = 16384) -> np.ndarray:
        """update() of each value in turn: what is learnt runs along the values, and then a block is guessed and scored at once."""
        k, r = self.order, self.discount
        first = min(len(values), max(0, k - len(self.past)))
        out = [np.array([self.update(v) for v in values[:first].tolist()], float)]
        along = lambda start, steps: np.array(list(accumulate(steps.tolist(), lambda old, step: (1 - r) * old + step, initial=start)))
        lags, ridge = np.abs(np.arange(k)[:, None] - np.arange(k)[None]), np.eye(k)
        for at in range(first, len(values), block):
            x = values[at : at + block]
            n, line = len(x), np.append(self.past, x)
            past = np.stack([line[k - j : k - j + n] for j in range(1, k + 1)], 1) if k else np.zeros((n, 0))
            mean = along(self.mean, r * x)
            off = r * (x - mean[1:])
            cov = np.stack([along(float(self.cov[j]), off * ((past[:, j - 1] if j else x) - mean[1:])) for j in range(k + 1)], 1)
            c = cov[:-1]
            tables = c[:, lags] + (1e-10 * np.maximum(np.abs(c[:, 0]), 1e-10))[:, None, None] * ridge
            guess = mean[:-1] + (np.linalg.solve(tables, c[:, 1:, None])[..., 0] * (past - mean[:-1, None])).sum(1)
            error = (x - guess) ** 2
            sigma = np.array(list(accumulate((r * error).tolist(), lambda old, step: max((1 - r) * old + step, 1e-10), initial=self.sigma)))
            self.mean, self.cov, self.sigma, self.past = float(mean[-1]), cov[-1].copy(), float(sigma[-1]), line[len(line) - k :].tolist()
            out.append(0.5 * np.log(2 * math.pi * sigma[1:]) + error / (2 * sigma[1:]))
        return np.concatenate(out)


def trailing_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of the last `width` values, which counts missing ones before the start as 0."""
    total = np.cumsum(np.append(0, x))
    i = np.arange(1, len(x) + 1)
    return (total[i] - total[np.maximum(i - width, 0)]) / width


def change_scores(x: np.ndarray, order: int, discount: float, smooth: int, kind: str = "logarithmic") -> np.ndarray:
    """Two passes of outlier scores by SDAR, each smoothed by a trailing mean."""
    n = len(x)

    def one_pass(y: np.ndarray, start: int) -> np.ndarray:
        model, out = Sdar(order, discount), np.full(n, np.nan)
        model.warm_up(y[:start])
        for t in range(start, n):
            out[t] = model.update(float(y[t]), kind)
        known = out[start:]
        out[:start] = np.median(known) if len(known) else 0.0
        return out

    start = min(max(2 * order, 30), n)
    first = trailing_mean(one_pass(x, start), smooth)
    second = one_pass(first, min(start + smooth, n))
    return trailing_mean(second, smooth)


@dataclass
class ChangeFinderDetector(Detector):
    order: int = 5
    discount: float = 0.005
    smooth_window: int = 7
    score: str = "logarithmic"
    n_cps: int | None = None
    threshold: float | None = None
    min_distance: int = 10
    multivariate_strategy: str = "l2"
    tolerance: float = 0
    PARAMS = (integer("order"), real("discount", 0, 1, "neither"), integer("smooth_window"), choice("score", "logarithmic", "quadratic"), integer("n_cps", nullable=True), real("threshold", None, nullable=True), integer("min_distance"), STRATEGY, real("tolerance", 0))

    def one(self, x):
        score = change_scores(x, self.order, self.discount, self.smooth_window, self.score)
        positive = score[score > 0]
        limit = self.threshold if self.threshold is not None else (positive.mean() + 2 * positive.std() if len(positive) else np.inf)
        peaks = local_maxima(score, max(1, self.min_distance // 2))
        peaks = peaks[np.argsort(-score[peaks], kind="stable")]
        if self.n_cps is not None:
            above = [p for p in peaks if score[p] > limit]
            return apart(np.array([*above, *(p for p in peaks if score[p] <= limit)], int), self.min_distance, self.n_cps)
        return apart(peaks[score[peaks] > limit], self.min_distance)

    def kernel(self, x):
        return channels(x, self.multivariate_strategy, self.one, self.tolerance, self.n_cps)


@dataclass
class FLUSSDetector(Detector):
    """Minima of the corrected arc curve of nearest neighbours."""

    window_size: int = 10
    n_segments: int = 2
    exclusion_factor: int = 5
    multivariate_strategy: str = "ensembling"
    tolerance: float = 0.01
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (integer("window_size", 2), integer("n_segments"), integer("exclusion_factor"), STRATEGY, real("tolerance", 0))

    def curve(self, x: np.ndarray) -> np.ndarray:
        w = self.window_size
        far = W.distances(x, w)
        i = np.arange(len(far))
        far[np.abs(i[:, None] - i[None]) <= math.ceil(w / 4)] = np.inf
        out = W.arc_curve(far.argmin(1))
        edge = self.exclusion_factor * w
        out[:edge], out[-edge:] = 1, 1
        return out

    def one(self, x):
        if len(x) < 2 * self.window_size:
            return []
        curve, out = self.curve(x), []
        for _ in range(self.n_segments - 1):
            i = int(curve.argmin())
            if curve[i] >= 1:
                break
            out.append(i)
            edge = self.exclusion_factor * self.window_size
            curve[max(0, i - edge) : i + edge + 1] = 1
        return out

    def kernel(self, x):
        return channels(x, self.multivariate_strategy, self.one, self.tolerance, self.n_segments - 1)


#: |z| of a two-sided p of 1e-15 and 1e-30.
Z_LIMITS = (8.02685888253454, 11.52388357738025)


@dataclass
class ClaspDetector(Detector):
    """Recursive splits where nearest neighbours best tell the sides apart, tested for significance."""

    n_segments: object = "learn"
    n_change_points: int | None = None
    n_estimators: int = 10
    window_size: object = "suss"
    k_neighbours: int = 3
    excl_radius: int = 5
    distance: str = "znormed_euclidean_distance"
    score: str = "roc_auc"
    early_stopping: bool = True
    validation: str | None = "significance_test"
    threshold: object = "default"
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (integer("n_estimators"), Param("window_size", (Options(tuple(W.WINDOW_SIZES)), *integer("w").any_of)), integer("k_neighbours"), integer("excl_radius"), choice("distance", "znormed_euclidean_distance", "euclidean_distance", "cinvariant_euclidean_distance"), choice("score", "roc_auc", "f1"), choice("validation", "significance_test", "score_threshold", nullable=True), Rule(lambda o: o.excl_radius > 0, "excl_radius must be positive"))

    def width(self, x: np.ndarray) -> int:
        if isinstance(self.window_size, int):
            return self.window_size
        return min(max(3, W.WINDOW_SIZES[self.window_size](x[:, c]) // 2) for c in range(x.shape[1]))

    def split(self, x: np.ndarray, w: int) -> tuple[int, float, np.ndarray] | None:
        """The best split of an ensemble of profiles over random stretches, with its score and the neighbours of all windows."""
        n, least = len(x) - w + 1, w * self.excl_radius
        if n < 2 * least:
            return None
        far = W.all_distances(x, w, self.distance)
        rng, spans = np.random.default_rng(2357), [(0, n)]
        for _ in range(self.n_estimators - 1):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            if b - a >= max(2 * least, 3):
                spans.append((a, b))
        best = None
        for a, b in sorted(set(spans), key=lambda s: s[0] - s[1]):
            area = (b - a) / n
            if self.early_stopping and best and best[1] >= (1 + area) / 2:
                break
            profile = W.split_profile(W.neighbours(far, w, self.k_neighbours, a, b), w, least, self.score)
            s = int(profile.argmax())
            if np.isfinite(profile[s]) and (best is None or (profile[s] + area) / 2 > best[1]):
                best = (a + s, (profile[s] + area) / 2, profile[s])
        return (best[0], float(best[2]), W.neighbours(far, w, self.k_neighbours)) if best else None

    def valid(self, found: tuple[int, float, np.ndarray], w: int, d: int) -> bool:
        s, score, offsets = found
        if self.validation == "score_threshold":
            return score >= (0.75 if self.threshold == "default" else self.threshold)
        if self.validation == "significance_test":
            return abs(W.rank_sum_z(W.votes(offsets, s, w), s)) >= Z_LIMITS[d > 1]
        return True

    def kernel(self, x):
        w = self.width(x)
        most = self.n_change_points if self.n_change_points is not None else (self.n_segments - 1 if isinstance(self.n_segments, int) else None)
        least, cps, open_ = w * self.excl_radius, [], []

        def look(a: int, b: int) -> None:
            found = self.split(x[a:b], w)
            if found and (most is not None or self.valid(found, w, x.shape[1])):
                open_.append((found[1], a + found[0], a, b))

        look(0, len(x))
        while open_ and (most is None or len(cps) < most):
            open_.sort(key=lambda o: (o[0], -o[1]))
            _, s, a, b = open_.pop()
            if all(abs(s - c) >= least for c in (0, len(x), *cps)):
                cps.append(s)
                look(a, s)
                look(s, b)
        return cps


@dataclass
class EspressoDetector(Detector):
    """Chains of nearest-neighbour arcs give a density; its valleys are candidates for a greedy choice by information gain."""

    window_size: int = 64
    chain_len: int = 3
    n_segments: int | None = None
    peak_distance_fraction: float = 0.01
    random_state: int | None = None
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (integer("window_size", 4), integer("chain_len"), integer("n_segments", 2, nullable=True), real("peak_distance_fraction", 0, 1))

    def density(self, x: np.ndarray) -> np.ndarray:
        w = self.window_size
        far = W.distances(x, w)
        i = np.arange(len(far))
        gap = round(w / 4)
        far[np.abs(i[:, None] - i[None]) <= gap] = np.inf
        nearest = far.argmin(1)
        profile = np.sqrt(np.sqrt(far.min(1)))
        limit = 2 * profile.max()
        arcs, cost, last = [(i, nearest)], profile.copy(), nearest
        going = np.ones(len(i), bool)
        for _ in range(self.chain_len - 1):
            new = nearest[last]
            cost = cost + profile[last]
            going &= (cost <= limit) & (np.abs(new - i) > gap)
            arcs.append((i[going], new[going]))
            last = new
        a = np.concatenate([np.minimum(p, q) for p, q in arcs])
        b = np.concatenate([np.maximum(p, q) for p, q in arcs])
        length = b - a
        weight = 1 - (length - length.min()) / max(length.max() - length.min(), 1)
        return np.cumsum(np.bincount(a, weight, len(i) + 1) - np.bincount(b, weight, len(i) + 1))[: len(i)]

    def kernel(self, x):
        if self.n_segments is None:
            raise ValueError("EspressoDetector: n_segments is needed")
        if len(x) < 2 * self.window_size:
            return []
        taps = np.exp(-0.5 * (np.arange(-2, 3) / (5 / 6)) ** 2)
        y = with_complement(x)
        sums = np.concatenate([np.zeros((1, y.shape[1])), y.cumsum(0)])
        best = (-np.inf, [])
        for c in range(x.shape[1]):
            valley = -np.convolve(np.pad(self.density(x[:, c]), 2, mode="edge"), taps / taps.sum(), "valid")
            peaks = find_peaks(valley, max(1, int(self.peak_distance_fraction * len(x))))
            pool = peaks[np.argsort(-prominences(valley, peaks), kind="stable")].tolist()
            chosen: list[int] = []
            while pool and len(chosen) < self.n_segments - 1:
                gains = [information_gain(sums, [*chosen, p]) for p in pool]
                chosen.append(pool.pop(int(np.argmax(gains))))
            gain = information_gain(sums, chosen)
            if chosen and gain > best[0]:
                best = (gain, chosen)
        return best[1]


def approximate_entropy(y: np.ndarray, m: int = 2) -> float:
    r = 0.2 * y.std()

    def phi(k: int) -> float:
        v = np.lib.stride_tricks.sliding_window_view(y, k)
        near = np.abs(v[:, None] - v[None]).max(-1) <= r
        return float(np.log(near.mean(1)).mean())

    return phi(m) - phi(m + 1) if len(y) > m + 1 else 0.0


@dataclass
class ICIDDetector(Detector):
    """Windows as means of isolation-kernel features; changes where consecutive ones differ."""

    window_size: int = 50
    alpha: float = 0.5
    t: int = 200
    psi_list: tuple[int, ...] | None = None
    random_state: int | None = 0
    PARAMS = (integer("window_size"), real("alpha", 0), integer("t"))

    def scores(self, x: np.ndarray, psi: int, rng: np.random.Generator) -> np.ndarray:
        count = len(x) // self.window_size
        sums = np.zeros((count, self.t * psi), "float32")
        owner = np.arange(count * self.window_size) // self.window_size
        for k in range(self.t):
            centres = x[rng.choice(len(x), psi, replace=False)]
            cell = ((x[: len(owner), None] - centres[None]) ** 2).sum(-1).argmin(1)
            np.add.at(sums, (owner, k * psi + cell), 1)
        unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        score = np.append(0, 1 - (unit[1:] * unit[:-1]).sum(1))
        return (score - score.min()) / max(score.max() - score.min(), 1e-12)

    def kernel(self, x):
        if len(x) < 2 * self.window_size:
            return []
        y, rng = np.where(np.ptp(x, axis=0) > 0, spread(x), 0.5), np.random.default_rng(self.random_state)
        tried = [self.scores(y, p, rng) for p in (self.psi_list or (2, 4, 8, 16, 32, 64)) if p <= len(x)]
        score = min(tried, key=approximate_entropy)
        point = np.repeat(score, self.window_size)
        high = point > point.mean() + self.alpha * point.std()
        return (np.flatnonzero(high[1:] & ~high[:-1]) + 1).tolist()


@dataclass
class ProphetDetector(Detector):
    """The places of a trend model's potential changes, which are spread evenly over the series."""

    n_changepoints: int = 5
    n_changepoint_func: object = None
    multivariate_strategy: str = "ensembling"
    tolerance: float = 0.01
    PARAMS = (integer("n_changepoints"), Param("n_changepoint_func", (Callable_(),), True), STRATEGY, real("tolerance", 0))

    def kernel(self, x):
        wanted = self.n_changepoint_func(x) if self.n_changepoint_func else self.n_changepoints
        wanted = min(int(wanted), len(x) - 1)
        return np.round(np.linspace(0, len(x) - 1, wanted + 1)).astype(int)[1:].tolist()


@dataclass
class BeastDetector(Detector):
    """Bayesian model averaging over piecewise polynomial trends (and harmonics) by birth, death and move steps."""

    season: str = "none"
    tcp_minmax: tuple[int, int] = (0, 10)
    torder_minmax: tuple[int, int] = (0, 1)
    tseg_minlength: int | None = None
    period: float | None = None
    sorder_minmax: tuple[int, int] = (0, 5)
    mcmc_samples: int = 2000
    mcmc_burnin: int = 200
    mcmc_chains: int = 1
    mcmc_thin: int = 5
    mcmc_seed: int = 0
    cp_prob_threshold: float = 0.1
    max_cps: int | None = None
    multivariate_strategy: str = "native"
    tolerance: float = 0
    PARAMS = (choice("season", "none", "harmonic"), integer("tseg_minlength", nullable=True), integer("mcmc_samples"), integer("mcmc_burnin", 0), integer("mcmc_chains"), integer("mcmc_thin"), integer("mcmc_seed", None), real("cp_prob_threshold", 0, 1), integer("max_cps", nullable=True), choice("multivariate_strategy", "native", "l2", "ensembling"))

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Probability of a change at each point, and the median number of changes."""
        n = len(x)
        y = (x - x.mean()) / max(x.std(), 1e-12)
        if self.season == "harmonic" and self.period:
            t = 2 * np.pi * np.arange(n) / self.period
            basis = np.stack([f(k * t) for k in range(1, self.sorder_minmax[1] + 1) for f in (np.sin, np.cos)], 1)
            y = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
        least = self.tseg_minlength or max(3, n // 100)
        order = self.torder_minmax[1]
        moments = [np.cumsum(np.append(0, (np.arange(n) / n) ** k)) for k in range(2 * order + 1)]
        cross = [np.cumsum(np.append(0, y * (np.arange(n) / n) ** k)) for k in range(order + 1)]
        squares, known = np.cumsum(np.append(0, y * y)), {}

        def evidence(s: int, e: int) -> tuple[float, float]:
            """Residual sum of squares and log determinant of a ridge fit on [s, e)."""
            if (s, e) not in known:
                a = np.array([[moments[i + j][e] - moments[i + j][s] for j in range(order + 1)] for i in range(order + 1)]) + 1e-3 * np.eye(order + 1)
                b = np.array([c[e] - c[s] for c in cross])
                known[s, e] = (squares[e] - squares[s] - b @ np.linalg.solve(a, b), np.linalg.slogdet(a)[1] - (order + 1) * math.log(1e-3))
            return known[s, e]

        def log_posterior(cps: list[int]) -> float:
            parts = [evidence(s, e) for s, e in zip([0, *cps], [*cps, n], strict=True)]
            return -0.5 * n * math.log(max(sum(p[0] for p in parts), 1e-9)) - 0.5 * sum(p[1] for p in parts) - len(cps) * math.log(n)

        hits, sizes = np.zeros(n), []
        for chain in range(self.mcmc_chains):
            rng, cps = np.random.default_rng(self.mcmc_seed + chain), []
            now = log_posterior(cps)
            for i in range(self.mcmc_burnin + self.mcmc_samples * self.mcmc_thin):
                kind, new = rng.random(), None
                if kind < 0.4 and len(cps) < self.tcp_minmax[1]:
                    new = sorted([*cps, int(rng.integers(least, max(least + 1, n - least)))])
                elif kind < 0.6 and len(cps) > self.tcp_minmax[0]:
                    new = [c for j, c in enumerate(cps) if j != int(rng.integers(len(cps)))] if len(cps) > 1 else []
                elif cps:
                    j = int(rng.integers(len(cps)))
                    new = sorted([*cps[:j], cps[j] + int(round(rng.normal(0, max(1, n / 50)))), *cps[j + 1 :]])
                if new is not None and all(e - s >= least for s, e in zip([0, *new], [*new, n], strict=True)):
                    then = log_posterior(new)
                    if math.log(rng.random()) < then - now:
                        cps, now = new, then
                if i >= self.mcmc_burnin and i % self.mcmc_thin == 0:
                    hits[cps] += 1
                    sizes.append(len(cps))
        return hits / max(len(sizes), 1), int(np.median(sizes)) if sizes else 0

    def one(self, x):
        prob, middle = self.posterior(x)
        near = np.convolve(prob, np.ones(5), "same")
        runs = np.split(np.arange(len(x)), np.flatnonzero(np.diff((near >= self.cp_prob_threshold).astype(int))) + 1)
        peaks = [int(r[np.argmax(prob[r])]) for r in runs if near[r[0]] >= self.cp_prob_threshold]
        peaks.sort(key=lambda p: -near[p])
        return peaks[: min(middle, self.max_cps) if self.max_cps is not None else middle]

    def kernel(self, x):
        if self.multivariate_strategy == "native" and x.shape[1] > 1:
            return sorted({p for c in range(x.shape[1]) for p in self.one(x[:, c])})
        return channels(x, "l2" if self.multivariate_strategy == "native" else self.multivariate_strategy, self.one, self.tolerance)


@dataclass
class TGLADDetector(Detector):
    """Second differences of the sum of partial correlations of sliding windows, by a sparse precision matrix of each."""

    window_size: int = 512
    stride: int = 128
    threshold: float = 0.5
    min_spacing: int | None = None
    penalty: float = 0.1
    eval_offset: float = 0.1
    PARAMS = (integer("window_size", 4), integer("stride"), real("threshold", 0), integer("min_spacing", nullable=True), real("penalty", 0), real("eval_offset", 0))

    def kernel(self, x):
        if x.shape[1] < 2 or len(x) < self.window_size:
            return []
        total = []
        for v in windows_of(x, self.window_size, self.stride):
            s = np.cov(zscore(v).T) + self.eval_offset * np.eye(x.shape[1])
            p = graphical_lasso(s, self.penalty * (1 - np.eye(len(s))))
            scale = np.sqrt(np.maximum(np.diag(p), 1e-12))
            total.append(round(float(np.triu(-p / np.outer(scale, scale), 1).sum()), 5))
        score = np.zeros(len(total))
        if len(total) > 2:
            score[1:-1] = np.abs(np.diff(total, 2))
        out: list[int] = []
        for i in np.flatnonzero(score >= self.threshold):
            at = int(i) * self.stride
            if not out or at - out[-1] >= (self.min_spacing or self.window_size):
                out.append(at)
        return out


def autoencode(z: np.ndarray, hidden: int, latent: int, shared: int, rng: np.random.Generator, weight: float, rate: float, epochs: int, patience: int) -> np.ndarray:
    """Trains encoder and decoder, whose first `shared` codes should not vary from a window to the next; returns those codes."""
    n, d = z.shape
    shape = lambda a, b: rng.normal(0, 1 / math.sqrt(a), (a, b))
    p = {"a": shape(d, hidden or latent), "c": shape(hidden or latent, d), "ab": np.zeros(hidden or latent), "cb": np.zeros(d)}
    if hidden:
        p |= {"m": shape(hidden, latent), "mb": np.zeros(latent), "w": shape(latent, hidden), "wb": np.zeros(hidden)}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}

    def forward(v):
        h = np.tanh(v @ p["a"] + p["ab"])
        code = np.tanh(h @ p["m"] + p["mb"]) if hidden else h
        g = np.tanh(code @ p["w"] + p["wb"]) if hidden else code
        return h, code, g, np.tanh(g @ p["c"] + p["cb"])

    best, wait, step = np.inf, 0, 0
    for _ in range(epochs):
        loss = 0.0
        for at in rng.permutation(np.arange(0, max(1, n - 1), 64)):
            v = z[at : at + 65]
            h, code, g, out = forward(v)
            d_out = 2 * (out - v) / v.size * (1 - out**2)
            move = np.diff(code[:, :shared], axis=0)
            loss += float(((out - v) ** 2).mean() + weight * (move**2).mean() if len(move) else 0)
            grad = {"c": g.T @ d_out, "cb": d_out.sum(0)}
            d_code = d_out @ p["c"].T
            if hidden:
                d_g = d_code * (1 - g**2)
                grad |= {"w": code.T @ d_g, "wb": d_g.sum(0)}
                d_code = d_g @ p["w"].T
            if len(move):
                d_move = 2 * weight * move / move.size
                d_code[1:, :shared] += d_move
                d_code[:-1, :shared] -= d_move
            d_code = d_code * (1 - code**2)
            if hidden:
                grad |= {"m": h.T @ d_code, "mb": d_code.sum(0)}
                d_code = (d_code @ p["m"].T) * (1 - h**2)
            grad |= {"a": v.T @ d_code, "ab": d_code.sum(0)}
            step += 1
            for k, gr in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * gr
                second[k] = 0.999 * second[k] + 0.001 * gr**2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        best, wait = (loss, 0) if loss < best - 1e-6 else (best, wait + 1)
        if wait >= patience:
            break
    return forward(z)[1][:, :shared]


@dataclass
class TireDetector(Detector):
    """Peaks of the distance between neighbouring windows' time-invariant codes, learned in the time and frequency domain."""

    window_size: int = 20
    stride: int = 1
    domain: str = "both"
    intermediate_dim_td: int = 0
    latent_dim_td: int = 1
    nr_shared_td: int = 1
    nr_ae_td: int = 3
    loss_weight_td: float = 1.0
    intermediate_dim_fd: int = 10
    latent_dim_fd: int = 1
    nr_shared_fd: int = 1
    nr_ae_fd: int = 3
    loss_weight_fd: float = 1.0
    nfft: int = 30
    peak_distance_fraction: float = 0.01
    max_epochs: int = 20
    patience: int = 5
    learning_rate: float = 1e-3
    n_segments: int | None = None
    random_state: int | None = None
    PARAMS = (integer("window_size", 2), integer("stride"), choice("domain", "time", "frequency", "both"), integer("max_epochs"), integer("patience"), real("learning_rate", 0, None, "right"), integer("n_segments", nullable=True), integer("nfft", 2), real("peak_distance_fraction", 0, 1))

    def codes(self, x: np.ndarray) -> np.ndarray:
        rng, out = np.random.default_rng(self.random_state), []
        v = windows_of(x, self.window_size, self.stride)
        kinds = []
        if self.domain in ("time", "both"):
            kinds.append((2 * spread(v.reshape(len(v), -1).reshape(-1, 1)).reshape(len(v), -1) - 1, self.intermediate_dim_td, self.latent_dim_td, self.nr_shared_td, self.nr_ae_td, self.loss_weight_td))
        if self.domain in ("frequency", "both"):
            f = np.abs(np.fft.rfft(v - v.mean(1, keepdims=True), self.nfft, axis=1)).reshape(len(v), -1)
            kinds.append((2 * f / max(f.max(), 1e-12) - 1, self.intermediate_dim_fd, self.latent_dim_fd, self.nr_shared_fd, self.nr_ae_fd, self.loss_weight_fd))
        for z, hidden, latent, shared, count, weight in kinds:
            for _ in range(count):
                code = autoencode(z, hidden, latent, shared, rng, weight, self.learning_rate, self.max_epochs, self.patience)
                out.append((code - code.mean(0)) / np.maximum(code.std(0), 1e-9))
        return np.hstack(out)

    def kernel(self, x):
        w = self.window_size
        if len(x) < 3 * w:
            return []
        code = self.codes(x)
        tent = np.concatenate([np.arange(1, w + 2), np.arange(w, 0, -1)]) / (w + 1) ** 2
        smooth = lambda y: np.convolve(np.pad(y, w, mode="edge"), tent, "valid")
        code = np.stack([smooth(code[:, c]) for c in range(code.shape[1])], 1)
        gap = max(1, w // self.stride)
        away = smooth(np.sqrt(((code[gap:] - code[:-gap]) ** 2).sum(1)))
        peaks = find_peaks(away, max(1, int(self.peak_distance_fraction * len(x))))
        high = prominences(away, peaks)
        order = peaks[np.argsort(-high, kind="stable")]
        if self.n_segments is not None:
            order = order[: self.n_segments - 1]
        elif len(peaks):
            order = order[: int((high > high.mean() + high.std()).sum())]
        return [int(p) * self.stride + w for p in order]


@dataclass
class TSCP2Detector(Detector):
    """Histories and futures embedded so that true pairs agree more than others (a linear encoder trained by the contrastive
    NCE loss); changes where they don't."""

    window_size: int = 128
    n_cps: int | None = None
    similarity_threshold: float | None = None
    stride: int = 5
    code_size: int = 32
    batch_size: int = 64
    epochs: int = 30
    learning_rate: float = 1e-2
    temperature: float = 0.1
    random_state: int | None = 0
    PARAMS = (integer("window_size", 4), integer("n_cps", nullable=True), real("similarity_threshold", -1, 1, nullable=True), integer("stride"), integer("code_size"), integer("batch_size", 2), integer("epochs"), real("learning_rate", 0, None, "right"), real("temperature", 0, None, "right"), exclusive("n_cps", "similarity_threshold"))

    def similarity(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Points between history and future, their similarity, and that of pairs that don't belong together."""
        w = max(4, min(self.window_size, len(x) // 4))
        v = windows_of(zscore(x), w, 1)
        at = np.arange(0, len(v) - w, self.stride)
        f = np.concatenate([v.reshape(len(v), -1), v.mean(1), v.std(1), np.abs(np.fft.rfft(v, axis=1))[:, : min(16, w // 2)].reshape(len(v), -1) / w], 1)
        f = zscore(f)
        h, g = f[at], f[at + w]
        rng = np.random.default_rng(self.random_state)
        m = rng.normal(0, 1 / math.sqrt(f.shape[1]), (f.shape[1], self.code_size))
        unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        square = np.zeros_like(m)
        for _ in range(self.epochs):
            order = rng.permutation(len(at))
            for i in range(0, len(order), self.batch_size):
                own = order[i : i + self.batch_size]
                if len(own) < 2:
                    continue
                a, b = h[own] @ m, g[own] @ m
                ua, ub = unit(a), unit(b)
                logits = ua @ ub.T / self.temperature
                p = np.exp(logits - logits.max(1, keepdims=True))
                error = (p / p.sum(1, keepdims=True) - np.eye(len(own))) / len(own) / self.temperature
                da, db = error @ ub, error.T @ ua
                back = lambda d, u, z: (d - (d * u).sum(1, keepdims=True) * u) / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                grad = h[own].T @ back(da, ua, a) + g[own].T @ back(db, ub, b)
                square = 0.9 * square + 0.1 * grad**2
                m -= self.learning_rate * grad / (np.sqrt(square) + 1e-8) / math.sqrt(f.shape[1])
        ua, ub = unit(h @ m), unit(g @ m)
        return at + w, (ua * ub).sum(1), float((ua @ ub.T).mean())

    def kernel(self, x):
        if len(x) < 16:
            return []
        at, same, other = self.similarity(x)
        gap = max(1, min(self.window_size, len(x) // 4) // 2)
        order = np.argsort(same, kind="stable")
        if self.n_cps is not None:
            return apart(at[order], gap, self.n_cps)
        limit = self.similarity_threshold if self.similarity_threshold is not None else same.mean() - (same.mean() - other) / 3
        return apart(at[[i for i in order if same[i] < limit]], gap)
