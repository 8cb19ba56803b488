"""Detectors that give every time step a state."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np

from ..functions import windowing as W
from ..functions.numeric import (
    by_first_seen,
    change_points_of,
    complete_linkage,
    dirichlet_mixture,
    graphical_lasso,
    kmeans,
    labels_of,
    majority_vote,
    segments_of,
    silhouette,
    switching_path,
    viterbi,
    windows_of,
    zscore,
)
from .base import MAX_PAIRS_POINTS, Detector
from .params import Options, Param, Rule, choice, integer, real
from .scores import ClaspDetector


def normal_density(mean: float, sd: float = 1.0):
    return lambda v: np.exp(-0.5 * ((v - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


@dataclass
class HMMDetector(Detector):
    """The likeliest path of a hidden Markov model whose emissions and transitions are given."""

    dense, multivariate = True, False
    emission_funcs: object = None
    transition_prob_mat: object = None
    initial_probs: object = None
    PARAMS = ()

    def kernel(self, x):
        emit = self.emission_funcs or [normal_density(0.0), normal_density(1.0)]
        k = len(emit)
        move = np.array([[0.9, 0.1], [0.1, 0.9]]) if self.transition_prob_mat is None else np.asarray(self.transition_prob_mat, float)
        start = np.full(k, 1 / k) if self.initial_probs is None else np.asarray(self.initial_probs, float)
        if move.shape != (k, k) or start.shape != (k,) or not np.allclose(move.sum(1), 1) or not np.isclose(start.sum(), 1):
            raise ValueError("HMMDetector: probabilities must fit the emissions and sum to 1")
        density = np.stack([np.vectorize(f, otypes=[float])(x[:, 0]) for f in emit], 1)
        with np.errstate(divide="ignore"):
            return viterbi(np.log(start), np.log(move), np.log(density))


@dataclass
class RandomDetector(Detector):
    """A baseline: random change points and states, no state twice in a row; the same for the same seed and series."""

    dense = True
    n_change_points: int | None = None
    n_states: int | None = None
    random_state: int | None = None
    PARAMS = (integer("n_change_points", 0, nullable=True), integer("n_states", 1, nullable=True))

    def for_series(self, series_id):
        if self.random_state is None:
            return self
        return self.replace(random_state=zlib.crc32(f"{self.random_state}/{series_id}".encode()))

    def kernel(self, x):
        rng, n = np.random.default_rng(self.random_state), len(x)
        count = self.n_change_points if self.n_change_points is not None else int(rng.integers(3, 15))
        count = min(count, n - 1)
        states = self.n_states or int(rng.integers(2, 11))
        label = labels_of(sorted(rng.choice(np.arange(1, n), count, replace=False).tolist()) if count else [], n)
        names, last = [], -1
        for _ in range(count + 1):
            last = int(rng.choice([s for s in range(states) if s != last or states == 1]))
            names.append(last)
        return np.array(names)[label]


@dataclass
class VSAXDetector(Detector):
    """Segments of varying length as words of symbols: a program chooses lengths by residual and penalty; like words are one state."""

    dense = True
    alphabet_size: int = 6
    paa_segments: int = 8
    min_segment_length: int = 20
    max_segment_length: int = 180
    num_lengths: int = 6
    penalty: float = 0.8
    symbol_merge_threshold: float = 0.2
    zscore: bool = True
    adaptive_breakpoints: bool = True
    random_state: int | None = 0
    PARAMS = (integer("alphabet_size", 2), integer("paa_segments"), integer("min_segment_length"), integer("max_segment_length"), integer("num_lengths"), real("penalty", 0), real("symbol_merge_threshold", 0), Rule(lambda o: o.max_segment_length >= o.min_segment_length, "max_segment_length must not be below min_segment_length"))

    def kernel(self, x):
        n, d = x.shape
        y = zscore(x) if self.zscore else x
        share = np.arange(1, self.alphabet_size) / self.alphabet_size
        if self.adaptive_breakpoints:
            breaks = np.quantile(y, share, axis=0).T
        else:
            breaks = np.tile(np.array([_normal_quantile(p) for p in share]), (d, 1))
        low, high = min(self.min_segment_length, n), min(self.max_segment_length, n)
        lengths = np.unique(np.round(np.linspace(low, max(low, high), self.num_lengths)).astype(int))
        first, second = np.cumsum(np.vstack([np.zeros(d), y]), 0), np.cumsum(np.vstack([np.zeros(d), y * y]), 0)

        def frames(s: int, e: int):
            edges = np.unique(np.round(np.linspace(s, e, min(self.paa_segments, e - s) + 1)).astype(int))
            size = np.diff(edges)[:, None]
            mean = (first[edges[1:]] - first[edges[:-1]]) / size
            return mean, (second[edges[1:]] - second[edges[:-1]]) / size - mean**2

        value, step = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        value[n] = 0.0
        for s in range(n - 1, -1, -1):
            ends = {s + int(m) for m in lengths if s + m <= n} | ({n} if n - s < lengths[0] * 2 else set())
            for e in sorted(ends):
                total = float(np.maximum(frames(s, e)[1], 0).mean()) + self.penalty + value[e]
                if total < value[s]:
                    value[s], step[s] = total, e
        cuts, words, s = [], [], 0
        while s < n:
            e = int(step[s])
            mean = frames(s, e)[0]
            mean = mean[np.round(np.linspace(0, len(mean) - 1, self.paa_segments)).astype(int)]
            words.append((mean[:, :, None] >= breaks[None]).sum(-1).ravel())
            cuts.append((s, e))
            s = e
        words = np.array(words)
        label = by_first_seen(complete_linkage(words / (self.alphabet_size * words.shape[1]), self.symbol_merge_threshold))
        out = np.empty(n, int)
        for (s, e), k in zip(cuts, label, strict=True):
            out[s:e] = k
        return out


def _normal_quantile(p: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


@dataclass
class TiccDetector(Detector):
    """Clusters of windows by block-Toeplitz precision matrices; assignment pays for each switch."""

    dense = True
    window_size: int = 10
    n_states: int = 5
    lambda_parameter: float = 0.11
    beta: float = 400.0
    maxIters: int = 30
    threshold: float = 2e-5
    PARAMS = (integer("window_size"), integer("n_states"), real("lambda_parameter", 0), real("beta", 0), integer("maxIters"), real("threshold", 0))

    def kernel(self, x):
        n, d = x.shape
        w = min(self.window_size, n)
        if n < 3 * w:
            return np.zeros(n, int)
        v = windows_of(x, w).reshape(-1, w * d)
        k = min(self.n_states, len(v))
        label, _ = kmeans(v, k, np.random.default_rng(102), 20)
        block = np.arange(w)

        def tie(a: np.ndarray) -> np.ndarray:
            """Blocks at one offset of time are equal."""
            cells = a.reshape(w, d, w, d).transpose(0, 2, 1, 3).copy()
            for o in range(w):
                i = block[: w - o]
                mean = (cells[i + o, i] + cells[i, i + o].transpose(0, 2, 1)).mean(0) / 2
                cells[i + o, i], cells[i, i + o] = mean, mean.T
            return cells.transpose(0, 2, 1, 3).reshape(w * d, w * d)

        for _ in range(self.maxIters):
            cost = np.zeros((len(v), k))
            sizes = np.bincount(label, minlength=k)
            for c in range(k):
                own = v[label == c]
                if len(own) < 2:
                    big = np.flatnonzero(label == sizes.argmax())
                    own = v[big[len(big) // 2 : len(big) // 2 + max(w, 2)]]
                s = np.cov(own.T, ddof=0).reshape(w * d, w * d) + 1e-3 * np.eye(w * d)
                p = graphical_lasso(s, self.lambda_parameter, 100, tie=tie)
                sign, log = np.linalg.slogdet(p)
                if sign <= 0:
                    p = np.linalg.inv(s)
                    log = np.linalg.slogdet(p)[1]
                centred = v - own.mean(0)
                cost[:, c] = np.einsum("ij,jk,ik->i", centred, p, centred) - log
            new = switching_path(cost, self.beta)
            if (new == label).all():
                break
            label = new
        return np.concatenate([label, np.full(n - len(label), label[-1])])


@dataclass
class HdpHsmmDetector(Detector):
    """Gibbs sampling of a hierarchical Dirichlet process hidden semi-Markov model, weak-limit form: Gaussian emissions, Poisson durations."""

    dense = True
    alpha: float = 6.0
    gamma: float = 6.0
    init_state_concentration: float = 6.0
    n_iter: int = 50
    n_max_states: int = 10
    trunc: int = 100
    kappa0: float = 0.25
    nu0: float | None = None
    prior_mean: float = 0.0
    prior_scale: float = 1.0
    dur_alpha: float = 2.0
    dur_beta: float = 0.1
    random_state: int | None = 0
    PARAMS = (real("alpha", 0, None, "neither"), real("gamma", 0, None, "neither"), integer("n_iter"), integer("n_max_states"), integer("trunc"), real("kappa0", 0, None, "neither"), real("dur_alpha", 0, None, "neither"), real("dur_beta", 0, None, "neither"))

    def kernel(self, x):
        rng, (n, d), k = np.random.default_rng(self.random_state), x.shape, self.n_max_states
        y, trunc = zscore(x), min(self.trunc, len(x))
        nu0 = self.nu0 if self.nu0 is not None else d + 2
        label, _ = kmeans(y, min(k, n), rng, 10)
        beta, best = np.full(k, 1 / k), None
        move, start, rate = np.full((k, k), 1 / k), np.full(k, 1 / k), np.full(k, self.dur_alpha / self.dur_beta)
        log_factorial = np.array([math.lgamma(i + 1) for i in range(trunc + 1)])
        for it in range(self.n_iter):
            mean, prec, logdet = np.zeros((k, d)), np.zeros((k, d, d)), np.zeros(k)
            for c in range(k):
                own = y[label == c]
                m = len(own)
                centre = own.mean(0) if m else np.zeros(d)
                dev = (own - centre).T @ (own - centre) if m else np.zeros((d, d))
                kn, nn = self.kappa0 + m, nu0 + m
                mn = (self.kappa0 * self.prior_mean + m * centre) / kn
                off = (centre - self.prior_mean)[:, None]
                scale = self.prior_scale * np.eye(d) + dev + self.kappa0 * m / kn * off @ off.T
                a = np.tril(rng.normal(size=(d, d)), -1) + np.diag(np.sqrt(rng.chisquare(nn - np.arange(d))))
                root = np.linalg.cholesky(np.linalg.inv(scale)) @ a
                prec[c] = root @ root.T
                mean[c] = rng.multivariate_normal(mn, np.linalg.inv(prec[c]) / kn)
                logdet[c] = np.linalg.slogdet(prec[c])[1]
            emit = np.stack([0.5 * logdet[c] - 0.5 * np.einsum("ij,jk,ik->i", y - mean[c], prec[c], y - mean[c]) for c in range(k)], 1)
            total = np.vstack([np.zeros(k), emit.cumsum(0)])
            length = np.arange(1, trunc + 1)
            last = (length[:, None] - 1) * np.log(rate) - rate - log_factorial[length - 1][:, None]
            with np.errstate(divide="ignore"):
                log_move, log_start = np.log(move), np.log(start)
            ahead, entry = np.zeros((n + 1, k)), np.full((n + 1, k), -np.inf)
            for t in range(n - 1, -1, -1):
                m = min(trunc, n - t)
                terms = total[t + 1 : t + m + 1] - total[t] + last[:m] + ahead[t + 1 : t + m + 1]
                if m == n - t:
                    tail = np.maximum(1 - np.exp(last[: m - 1]).sum(0), 1e-300) if m > 1 else np.ones(k)
                    terms[m - 1] = total[n] - total[t] + np.log(tail)
                top = terms.max(0)
                entry[t] = top + np.log(np.exp(terms - top).sum(0))
                both = log_move + entry[t]
                top = both.max(1)
                ahead[t] = top + np.log(np.exp(both - top[:, None]).sum(1))
            label, t, log_p = np.empty(n, int), 0, log_start + entry[0]
            runs = []
            while t < n:
                p = np.exp(log_p - log_p.max())
                c = int(rng.choice(k, p=p / p.sum()))
                m = min(trunc, n - t)
                terms = total[t + 1 : t + m + 1, c] - total[t, c] + last[:m, c] + ahead[t + 1 : t + m + 1, c]
                p = np.exp(terms - terms.max())
                e = int(rng.choice(m, p=p / p.sum())) + 1
                label[t : t + e] = c
                runs.append((c, e))
                t += e
                if t < n:
                    log_p = log_move[c] + entry[t]
            moves = np.zeros((k, k))
            for (a, _), (b, _) in zip(runs, runs[1:], strict=False):
                moves[a, b] += 1
            tables = np.array([[sum(rng.random() < self.alpha * beta[j] / (self.alpha * beta[j] + i) for i in range(int(moves[a, j]))) for j in range(k)] for a in range(k)])
            beta = rng.dirichlet(self.gamma / k + tables.sum(0))
            move = np.stack([rng.dirichlet(np.maximum(self.alpha * beta + moves[a], 1e-6)) for a in range(k)])
            np.fill_diagonal(move, 0)
            move /= move.sum(1, keepdims=True)
            start = rng.dirichlet(self.init_state_concentration / k + np.eye(k)[runs[0][0]])
            for c in range(k):
                own = [e - 1 for s, e in runs if s == c]
                rate[c] = rng.gamma(self.dur_alpha + sum(own), 1 / (self.dur_beta + len(own)))
            fit = float(emit[np.arange(n), label].sum())
            if it >= self.n_iter // 2 and (best is None or fit > best[0]):
                best = (fit, label.copy())
        return by_first_seen(best[1] if best else label)


@dataclass
class HidalgoDetector(Detector):
    """A mixture of local intrinsic dimensions, neighbours preferring a component; -1 where none reaches a probability of 0.8."""

    dense = True
    K_states: int = 2
    zeta: float = 0.8
    q: int = 3
    n_iter: int = 300
    burn_in: float = 0.5
    sampling_rate: int = 5
    use_Potts: bool = True
    seed: int = 0
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (integer("K_states"), real("zeta", 0.5, 1, "neither"), integer("q"), integer("n_iter"), real("burn_in", 0, 1), integer("sampling_rate"), integer("seed", None))

    def kernel(self, x):
        rng, n, k = np.random.default_rng(self.seed), len(x), self.K_states
        if n <= self.q + 1:
            return np.zeros(n, int)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(far, np.inf)
        near = np.argsort(far, axis=1, kind="stable")[:, : self.q]
        ranked = np.sort(far, axis=1)
        ratio = np.log(np.maximum(ranked[:, 1], 1e-12) / np.maximum(ranked[:, 0], 1e-12))
        inverse = [np.flatnonzero((near == i).any(1)) for i in range(n)]
        z, votes, kept = rng.integers(0, k, n), np.zeros((n, k)), 0
        bonus = math.log(self.zeta / (1 - self.zeta)) if self.use_Potts else 0.0
        for it in range(self.n_iter):
            count = np.bincount(z, minlength=k)
            dim = rng.gamma(1 + count, 1 / (1 + np.bincount(z, ratio, minlength=k)))
            share = rng.dirichlet(1 + count)
            log = np.log(share) + np.log(dim) - (dim + 1) * ratio[:, None]
            noise = rng.gumbel(size=(n, k))
            for i in range(n):
                agree = np.bincount(z[near[i]], minlength=k) + np.bincount(z[inverse[i]], minlength=k)
                z[i] = int(np.argmax(log[i] + bonus * agree + noise[i]))
            if it >= self.burn_in * self.n_iter and it % self.sampling_rate == 0:
                votes[np.arange(n), z] += 1
                kept += 1
        p = votes / max(kept, 1)
        return np.where(p.max(1) >= 0.8, p.argmax(1), -1)


def log_star(v: float) -> float:
    """Bits of an integer in the universal code."""
    out, v = 0.0, float(v)
    while v > 1:
        v = math.log2(v)
        out += v
    return out + 1.5


@dataclass
class AutoPlaitDetector(Detector):
    """Regimes of hidden Markov models found by splitting one in two as long as the description gets shorter."""

    dense = True
    n_cps: int | None = None
    max_states: int = 4
    random_state: int | None = 0
    PARAMS = (integer("n_cps", nullable=True), integer("max_states"))

    def learn(self, x: np.ndarray, segments: list[tuple[int, int]], rng) -> dict:
        """The hidden Markov model of segments with the number of states of least cost (hard assignments)."""
        best = None
        y = np.concatenate([x[s:e] for s, e in segments])
        for k in range(1, self.max_states + 1):
            if len(y) < 3 * k:
                break
            label, _ = kmeans(y, k, rng, 10)
            for _ in range(5):
                mean = np.array([y[label == j].mean(0) if (label == j).any() else y.mean(0) for j in range(k)])
                var = np.array([y[label == j].var(0) if (label == j).any() else y.var(0) for j in range(k)]) + 1e-2 * y.var(0) + 1e-6
                move, start, at = np.ones((k, k)), np.ones(k), 0
                for s, e in segments:
                    own = label[at : at + e - s]
                    np.add.at(move, (own[:-1], own[1:]), 1)
                    start[own[0]] += 1
                    at += e - s
                model = {"k": k, "mean": mean, "var": var, "move": np.log(move / move.sum(1, keepdims=True)), "start": np.log(start / start.sum())}
                emit = self.emission(model, y)
                label = np.concatenate([viterbi(model["start"], model["move"], emit[a : a + e - s]) for (s, e), a in zip(segments, np.cumsum([0, *(e - s for s, e in segments)]), strict=False)])
            cost = self.model_cost(k, x.shape[1]) + sum(self.data_cost(model, x[s:e]) for s, e in segments)
            if best is None or cost < best[0]:
                best = (cost, model)
        if best is None:
            model = {"k": 1, "mean": y.mean(0)[None], "var": y.var(0)[None] + 1e-6, "move": np.zeros((1, 1)), "start": np.zeros(1)}
            best = (self.model_cost(1, x.shape[1]), model)
        return best[1] | {"cost": best[0]}

    @staticmethod
    def emission(model: dict, y: np.ndarray) -> np.ndarray:
        return -0.5 * (np.log(2 * math.pi * model["var"]).sum(1) + ((y[:, None] - model["mean"]) ** 2 / model["var"]).sum(-1))

    @staticmethod
    def model_cost(k: int, d: int) -> float:
        return 32 * (k + k * k + 2 * k * d) + log_star(k)

    def data_cost(self, model: dict, y: np.ndarray) -> float:
        emit, score = self.emission(model, y), None
        for row in emit:
            if score is None:
                score = model["start"] + row
            else:
                both = score[:, None] + model["move"]
                top = both.max(0)
                score = top + np.log(np.exp(both - top).sum(0)) + row
        top = score.max()
        return -float(top + math.log(np.exp(score - top).sum())) / math.log(2)

    def split(self, x: np.ndarray, segments: list[tuple[int, int]], rng) -> tuple[float, list, list, list] | None:
        """Two regimes and their segments: models from two samples, then turns of a joint path with switches and of learning."""
        total = sum(e - s for s, e in segments)
        size = max(10, total // 20)
        pool = [(a, min(a + size, e)) for s, e in segments for a in range(s, e, size) if min(a + size, e) - a >= 5]
        if len(pool) < 2:
            return None
        best = None
        firsts = [self.learn(x, [p], rng) for p in (pool[i] for i in np.unique(np.linspace(0, len(pool) - 1, min(6, len(pool))).astype(int)))]
        far = [(sum(self.data_cost(a, x[s:e]) for s, e in pool[:: max(1, len(pool) // 10)]), a) for a in firsts]
        pairs = [(a, b) for i, (_, a) in enumerate(far) for _, b in far[i + 1 :]]
        price = lambda pair: sum(min(self.data_cost(pair[0], x[s:e]), self.data_cost(pair[1], x[s:e])) for s, e in pool)
        models = list(min(pairs, key=price)) if pairs else None
        if models is None:
            return None
        for _ in range(6):
            k0 = models[0]["k"]
            k = k0 + models[1]["k"]
            stay, parts = math.log(1 - 1 / size), ([], [])
            move = np.full((k, k), math.log(1 / size / k))
            move[:k0, :k0], move[k0:, k0:] = models[0]["move"] + stay, models[1]["move"] + stay
            start = np.concatenate([models[0]["start"], models[1]["start"]]) - math.log(2)
            for s, e in segments:
                emit = np.hstack([self.emission(m, x[s:e]) for m in models])
                side = (viterbi(start, move, emit) >= k0).astype(int)
                for a, b in segments_of(change_points_of(side), e - s):
                    parts[side[a]].append((s + a, s + b))
            if not parts[0] or not parts[1]:
                break
            models = [self.learn(x, p, rng) for p in parts]
            cost = self.total(models, parts, len(x))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, models, parts[0], parts[1])
            else:
                break
        return best

    @staticmethod
    def total(models: list, parts, n: int) -> float:
        return sum(m["cost"] for m in models) + sum(log_star(e - s) + math.log2(len(models)) for p in parts for s, e in p) + log_star(sum(len(p) for p in parts))

    def kernel(self, x):
        rng, y = np.random.default_rng(self.random_state), zscore(x)
        open_, done = [[(0, len(x))]], []
        while open_:
            own = open_.pop()
            one = self.total([self.learn(y, own, rng)], [own], len(x)) if len(done) + len(open_) < 20 else -np.inf
            found = self.split(y, own, rng)
            if found and found[0] < one:
                open_ += [found[2], found[3]]
            else:
                done.append(own)
        out = np.zeros(len(x), int)
        for c, parts in enumerate(done):
            for s, e in parts:
                out[s:e] = c
        if self.n_cps is not None:
            cps = change_points_of(out)
            if len(cps) > self.n_cps:
                size = {c: min(abs(c - o) for o in [0, len(x), *cps] if o != c) for c in cps}
                keep = sorted(sorted(cps, key=lambda c: -size[c])[: self.n_cps])
                new = np.zeros(len(x), int)
                for s, e in segments_of(keep, len(x)):
                    new[s:e] = np.bincount(out[s:e]).argmax()
                out = new
        return by_first_seen(out)


def convolution_features(v: np.ndarray, rng: np.random.Generator, kernels: int = 200) -> np.ndarray:
    """Random dilated convolutions of windows (windows, width, channels), each as its maximum and its share of positive values."""
    out = []
    for _ in range(kernels):
        size = int(rng.choice([5, 7, 9]))
        size = min(size, v.shape[1])
        step = 1 << int(rng.integers(0, max(1, int(math.log2(max(2, (v.shape[1] - 1) / size))) + 1)))
        step = max(1, min(step, (v.shape[1] - 1) // max(1, size - 1)))
        weight, bias = rng.normal(size=size), rng.uniform(-1, 1)
        channel = int(rng.integers(v.shape[2]))
        reach = v.shape[1] - (size - 1) * step
        y = sum(w * v[:, i * step : i * step + reach, channel] for i, w in enumerate(weight - weight.mean())) + bias
        out += [y.max(1), (y > 0).mean(1)]
    return np.stack(out, 1)


def ridge_folds(f: np.ndarray, label: np.ndarray, folds: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of rows predicted by ridge classifiers that did not see them."""
    f = zscore(f)
    classes, y = np.unique(label, return_inverse=True)
    target = np.eye(len(classes))[y] * 2 - 1
    fold, out = rng.permutation(len(f)) % folds, np.zeros(len(f), int)
    for k in range(folds):
        a, b = f[fold != k], target[fold != k]
        g = a @ a.T + 10.0 * np.eye(len(a)) if len(a) < a.shape[1] else None
        weight = a.T @ np.linalg.solve(g, b) if g is not None else np.linalg.solve(a.T @ a + 10.0 * np.eye(a.shape[1]), a.T @ b)
        out[fold == k] = classes[(f[fold == k] @ weight).argmax(1)]
    return out


@dataclass
class ClapDetector(Detector):
    """Change points, then a classifier of windows; states that it confuses are merged while it gains by that."""

    dense = True
    window_size: object = "suss"
    classifier: str = "rocket"
    merge_score: str = "cgain"
    n_splits: int = 5
    sample_size: int = 1000
    random_state: int | None = 42
    n_change_points: int | None = None
    change_points: tuple[int, ...] | None = None
    n_segments: object = "learn"
    max_points: int | None = MAX_PAIRS_POINTS
    PARAMS = (Param("window_size", (Options(tuple(W.WINDOW_SIZES)), *integer("w").any_of)), choice("classifier", "rocket", "raw"), choice("merge_score", "cgain", "accuracy"), integer("n_splits", 2), integer("sample_size"), integer("n_change_points", 0, nullable=True))

    def kernel(self, x):
        n = len(x)
        w = self.window_size if isinstance(self.window_size, int) else int(np.mean([W.WINDOW_SIZES[self.window_size](x[:, c]) for c in range(x.shape[1])]))
        w = max(3, min(w, n // 4))
        cps = list(self.change_points) if self.change_points is not None else ClaspDetector(n_change_points=self.n_change_points, n_segments=self.n_segments).fit_predict(x).tolist()
        segments = segments_of(cps, n)
        if len(segments) < 2:
            return np.zeros(n, int)
        rng = np.random.default_rng(self.random_state)
        step = max(1, w // 2)
        spots, owner = [], []
        for i, (s, e) in enumerate(segments):
            own = list(range(s, max(s + 1, e - w + 1), step))
            for a in own:
                spots.append(min(a, n - w))
                owner.append(i)
        spots, owner = np.array(spots), np.array(owner)
        if len(spots) > self.sample_size:
            some = np.sort(rng.choice(len(spots), self.sample_size, replace=False))
            spots, owner = spots[some], owner[some]
        v = np.stack([zscore(x[a : a + w]) for a in spots])
        f = convolution_features(v, rng) if self.classifier == "rocket" else v.reshape(len(v), -1)
        state = np.arange(len(segments))

        def judge(state):
            truth = state[owner]
            if len(set(truth.tolist())) < 2:
                return 0.0, truth
            said = ridge_folds(f, truth, min(self.n_splits, len(truth)), np.random.default_rng(self.random_state))
            hit = float((said == truth).mean())
            if self.merge_score == "accuracy":
                return hit, said
            share = np.bincount(truth) / len(truth)
            return hit - float((share**2).sum()), said

        score, said = judge(state)
        while len(set(state.tolist())) > 1:
            truth = state[owner]
            names = sorted(set(state.tolist()))
            mixed = {(a, b): ((said == b)[truth == a].mean() + (said == a)[truth == b].mean()) for i, a in enumerate(names) for b in names[i + 1 :]}
            done = True
            for a, b in sorted(mixed, key=lambda p: -mixed[p]):
                if mixed[a, b] <= 0:
                    break
                new = np.where(state == b, a, state)
                new_score, new_said = judge(new)
                if new_score >= score:
                    state, score, said, done = new, new_score, new_said, False
                    break
            if done:
                break
        out = np.empty(n, int)
        for (s, e), k in zip(segments, state, strict=True):
            out[s:e] = k
        return by_first_seen(out)


@dataclass
class PatssDetector(Detector):
    """Frequent patterns of discretised windows at several resolutions; their smoothed support is clustered, and a logistic model of
    the clusters gives the states."""

    dense = True
    word: int = 16
    alphabet: int = 3
    top_k: int = 25
    states: tuple[int, int] = (2, 9)
    widths: tuple[int, ...] | None = None
    smooth: float = 0.05
    random_state: int | None = 0
    PARAMS = (integer("word"), integer("alphabet", 2), integer("top_k"), real("smooth", 0, 1))

    def embedding(self, x: np.ndarray) -> np.ndarray:
        n, rows = len(x), []
        for c in range(x.shape[1]):
            y = zscore(x[:, [c]])[:, 0]
            breaks = np.quantile(y, np.arange(1, self.alphabet) / self.alphabet)
            for w in self.widths or sorted({max(4, n // 40), max(4, n // 20)}):
                step = max(1, w // self.word)
                symbol = (np.add.reduceat(y, np.arange(0, n, step)) / np.diff([*range(0, n, step), n]))[:, None] >= breaks
                symbol = symbol.sum(1)
                for length in (2, 3, 4):
                    if len(symbol) < length:
                        continue
                    grams = np.lib.stride_tricks.sliding_window_view(symbol, length)
                    names, back, count = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
                    for k in np.argsort(-count, kind="stable")[: max(1, self.top_k // 3)]:
                        hit = np.zeros(n)
                        for i in np.flatnonzero(back.ravel() == k):
                            hit[i * step : (i + length) * step] = 1
                        rows.append(hit)
        m = np.array(rows)
        width = max(3, int(self.smooth * n))
        pad = np.pad(m, ((0, 0), (width // 2, width - 1 - width // 2)), mode="edge")
        total = np.cumsum(np.hstack([np.zeros((len(m), 1)), pad]), 1)
        m = (total[:, width:] - total[:, :-width]) / width
        keep: list[int] = []
        for i in np.argsort(-m.var(1), kind="stable"):
            if m[i].var() > 1e-9 and all(np.minimum(m[i], m[j]).sum() <= 0.9 * np.maximum(m[i], m[j]).sum() for j in keep):
                keep.append(int(i))
            if len(keep) == self.top_k:
                break
        return m[keep].T

    def kernel(self, x):
        if len(x) < 16:
            return np.zeros(len(x), int)
        e = self.embedding(x)
        if not e.shape[1]:
            return np.zeros(len(x), int)
        rng = np.random.default_rng(self.random_state)
        some = e[np.unique(np.linspace(0, len(e) - 1, min(len(e), 400)).astype(int))]
        best = max(((silhouette(some, kmeans(some, k, np.random.default_rng(k))[0]), -k) for k in range(self.states[0], self.states[1] + 1) if k < len(some)), default=(0, -2))
        k = -best[1]
        label, _ = kmeans(e, k, rng)
        z = np.hstack([zscore(e), np.ones((len(e), 1))])
        weight = np.zeros((z.shape[1], k))
        for _ in range(200):
            logits = z @ weight
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            weight -= 0.5 * (z.T @ (p - np.eye(k)[label]) / len(z) + 1e-3 * weight)
            weight = np.sign(weight) * np.maximum(np.abs(weight) - 1e-4, 0)
        return by_first_seen((z @ weight).argmax(1))


def contrastive_encoder(v: np.ndarray, out: int, rng: np.random.Generator, steps: int, rate: float, spans: int = 8, per: int = 4) -> np.ndarray:
    """Window features -> codes of a linear-tanh encoder: samples from one stretch are drawn together, means of stretches apart (log sigmoid)."""
    n, d = v.shape
    m = rng.normal(0, 1 / math.sqrt(d), (d, out))
    square = np.zeros_like(m)
    for _ in range(steps):
        starts = rng.integers(0, max(1, n - per), spans)
        own = (starts[:, None] + np.arange(per)[None]).ravel() % n
        h = np.tanh(v[own] @ m)
        group = np.repeat(np.arange(spans), per)
        mean = np.stack([h[group == g].mean(0) for g in range(spans)])
        d_h = np.zeros_like(h)
        for g in range(spans):
            z = h[group == g]
            s = 1 / (1 + np.exp(z @ z.T))
            d_h[group == g] -= (s + s.T) @ z / (per * per * spans)
        s = 1 / (1 + np.exp(-(mean @ mean.T)))
        np.fill_diagonal(s, 0)
        d_h += ((s + s.T) @ mean / (spans * max(1, spans - 1)))[group] / per
        grad = v[own].T @ (d_h * (1 - h**2))
        square = 0.9 * square + 0.1 * grad**2
        m -= rate * grad / (np.sqrt(square) + 1e-8)
    return np.tanh(v @ m)


@dataclass
class Time2StateDetector(Detector):
    """Codes of sliding windows from a contrastive encoder, clustered by a Dirichlet-process mixture, and a vote for each time step."""

    dense = True
    window_size: int = 256
    step: int = 50
    n_states: int = 20
    alpha: float = 1000.0
    nb_steps: int = 20
    lr: float = 0.003
    out_channels: int = 4
    random_state: int | None = 0
    PARAMS = (integer("window_size", 2), integer("step"), integer("n_states"), real("alpha", 0, None, "neither"), integer("nb_steps"), real("lr", 0, None, "neither"), integer("out_channels"))

    def features(self, x: np.ndarray, w: int, step: int) -> np.ndarray:
        v = windows_of((x - x.mean()) / max(x.std(), 1e-12), w, step)
        f = np.abs(np.fft.rfft(v, axis=1))[:, 1:9] / w
        return zscore(np.concatenate([v.mean(1), v.std(1), np.abs(np.diff(v, axis=1)).mean(1), f.reshape(len(v), -1)], 1))

    def kernel(self, x):
        n = len(x)
        w = max(4, min(self.window_size, n // 4))
        step = max(1, min(self.step, w // 4))
        if n < 2 * w:
            return np.zeros(n, int)
        rng = np.random.default_rng(self.random_state)
        code = contrastive_encoder(self.features(x, w, step), self.out_channels, rng, 10 * self.nb_steps, self.lr * 3)
        return by_first_seen(majority_vote(dirichlet_mixture(code, self.n_states, self.alpha / 1000, rng), n, w, step))


@dataclass
class E2USDDetector(Time2StateDetector):
    """The same with windows taken apart into a low-passed trend and a season."""

    def features(self, x, w, step):
        y = (x - x.mean()) / max(x.std(), 1e-12)
        f = np.fft.rfft(y, axis=0)
        f[max(2, len(f) // 2) :] = 0
        y = np.fft.irfft(f, len(y), axis=0)
        trend = np.stack([np.convolve(np.pad(y[:, c], 2, mode="edge"), np.ones(5) / 5, "valid") for c in range(y.shape[1])], 1)
        return np.hstack([super().features(trend, w, step), super().features(y - trend, w, step)])


@dataclass
class VQTSSDetector(Detector):
    """Window codes quantised by a codebook of moving averages; the nearest codeword is the state."""

    dense = True
    window_size: int = 128
    stride: int = 1
    hidden_dim: int = 16
    num_embeddings: int = 16
    decay: float = 0.9
    epochs: int = 10
    batch_size: int = 64
    smoothness_weight: float = 0.1
    random_state: int | None = 0
    PARAMS = (integer("window_size", 2), integer("stride"), integer("hidden_dim"), integer("num_embeddings", 2), real("decay", 0, 1, "left"), integer("epochs"), integer("batch_size"), real("smoothness_weight", 0))

    def kernel(self, x):
        n = len(x)
        w = max(4, min(self.window_size, n // 4))
        if n < 2 * w:
            return np.zeros(n, int)
        rng = np.random.default_rng(self.random_state)
        f = Time2StateDetector().features(x, w, self.stride)
        u, s, vt = np.linalg.svd(f - f.mean(0), full_matrices=False)
        z = u[:, : self.hidden_dim] * s[: self.hidden_dim]
        z = z / max(z.std(), 1e-9)
        _, book = kmeans(z, min(self.num_embeddings, len(z)), rng, 5)
        size, total = np.ones(len(book)), book.copy()
        for _ in range(self.epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), self.batch_size):
                own = z[order[at : at + self.batch_size]]
                k = ((own[:, None] - book[None]) ** 2).sum(-1).argmin(1)
                size = self.decay * size + (1 - self.decay) * np.bincount(k, minlength=len(book))
                total = self.decay * total
                np.add.at(total, k, (1 - self.decay) * own)
                book = total / np.maximum(size, 1e-6)[:, None]
        cost = ((z[:, None] - book[None]) ** 2).sum(-1)
        path = switching_path(cost, self.smoothness_weight * float(cost.mean()) * 10)
        return by_first_seen(majority_vote(path, n, w, self.stride))


