"""Window widths, subsequence neighbours, arc curves and split scores."""

from __future__ import annotations

import math

import numpy as np

from .numeric import spread


def suss_score(x: np.ndarray, width: int, whole: tuple[float, float, float]) -> float:
    """Mean distance between the windows' (mean, deviation, range) and the whole series', by the root of the width."""
    view = np.lib.stride_tricks.sliding_window_view(x, width)
    own = np.stack([view.mean(1), view.std(1), view.max(1) - view.min(1)], 1)[1:]
    if not len(own):
        return 0.0
    return float((np.sqrt(((own - whole) ** 2).sum(1)) / math.sqrt(width)).mean())


def suss(x: np.ndarray, least: int = 10, threshold: float = 0.89) -> int:
    """Width at which windows look like the whole: doubled until the score passes the threshold, then halved in on."""
    x = spread(np.asarray(x, float))
    if len(x) < 2 * least or x.max() == x.min():
        return max(1, min(least, len(x) // 2))
    whole = (x.mean(), x.std(), 1.0)
    high_score, low_score = suss_score(x, 1, whole), suss_score(x, len(x) - 1, whole)
    scale = lambda w: 1 - (suss_score(x, w, whole) - low_score) / max(high_score - low_score, 1e-12)
    power = 0
    while 2**power < len(x) // 2 and (2**power < least or scale(2**power) <= threshold):
        power += 1
    low, high = max(least, 2 ** max(power - 1, 0)), min(2**power + 1, len(x) - 1)
    while low < high:
        middle = (low + high) // 2
        value = scale(middle)
        if value < threshold:
            low = middle + 1
        elif value > threshold:
            high = middle
        else:
            break
    return 2 * low


def dominant_period(x: np.ndarray, low: int = 10, high: int = 1000) -> int:
    power = np.abs(np.fft.rfft(x - x.mean()))
    with np.errstate(divide="ignore"):
        period = np.where(np.arange(len(power)) > 0, len(x) / np.maximum(np.arange(len(power)), 1), np.inf)
    ok = np.flatnonzero((period >= low) & (period < high))
    return int(period[ok[np.argmax(power[ok])]]) if len(ok) else low


def autocorrelation_period(x: np.ndarray, low: int = 10, high: int = 1000) -> int:
    y = x - x.mean()
    size = 1 << (2 * len(y)).bit_length()
    f = np.fft.rfft(y, size)
    acf = np.fft.irfft(f * np.conj(f), size)[: len(y)]
    acf = acf / acf[0] if acf[0] else acf
    peaks = [i for i in range(1, len(acf) - 1) if acf[i] > acf[i - 1] and acf[i] > acf[i + 1] and low <= i < high]
    return max(peaks, key=lambda i: acf[i]) if peaks else low


WINDOW_SIZES = {"suss": suss, "fft": dominant_period, "acf": autocorrelation_period}


def rolling(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all windows; a deviation below 1e-3 counts as 1."""
    first, second = np.cumsum(np.append(0, x)), np.cumsum(np.append(0, x * x))
    mean = (first[w:] - first[:-w]) / w
    sd = np.sqrt(np.maximum((second[w:] - second[:-w]) / w - mean**2, 0))
    return mean, np.where(sd < 1e-3, 1.0, sd)


def distances(x: np.ndarray, w: int, kind: str = "znormed_euclidean_distance") -> np.ndarray:
    """Squared distances of all pairs of windows of one channel."""
    view = np.lib.stride_tricks.sliding_window_view(x - x.mean(), w)
    dot = view @ view.T
    if kind == "znormed_euclidean_distance":
        mean, sd = rolling(x - x.mean(), w)
        return np.maximum(2 * w * (1 - (dot - w * np.outer(mean, mean)) / (w * np.outer(sd, sd))), 0)
    square = np.diag(dot)
    plain = np.maximum(square[:, None] + square[None] - 2 * dot, 0)
    if kind == "euclidean_distance":
        return plain
    if kind == "cinvariant_euclidean_distance":
        step = np.sqrt((np.diff(view, axis=1) ** 2).sum(1)) + 1e-8
        return plain * (np.maximum.outer(step, step) / np.minimum.outer(step, step))
    raise ValueError(f"unknown distance {kind!r}")


def all_distances(x: np.ndarray, w: int, kind: str = "znormed_euclidean_distance") -> np.ndarray:
    """Mean over channels, each with its distances brought to mean 0 and deviation 1 first if there are several."""
    each = [distances(x[:, c], w, kind) for c in range(x.shape[1])]
    if len(each) == 1:
        return each[0]
    return sum((d - d.mean()) / max(d.std(), 1e-12) for d in each) / len(each)


def neighbours(far: np.ndarray, w: int, k: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """The k nearest windows of each, nearest first and of equals the first, none nearer in time than half a window."""
    far = far[low:high, low:high].copy()
    i = np.arange(len(far))
    far[np.abs(i[:, None] - i[None]) <= w // 2] = np.inf
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def split_profile(offsets: np.ndarray, w: int, least: int, score: str = "roc_auc") -> np.ndarray:
    """How well neighbours tell left from right, for each split; -inf outside [least, n - least + w).

    A window votes right of split s if the majority of its neighbours lies there, which is when the (k // 2 + 1)-th largest
    of their positions is s or more. So counts of votes are suffix sums over those positions; the w windows that straddle
    the split vote right."""
    n, k = offsets.shape
    major = np.sort(offsets, axis=1)[:, k - (k // 2 + 1)]
    suffix = lambda v: np.concatenate([np.cumsum(np.bincount(v, minlength=n + 1)[::-1])[::-1], [0]])
    s = np.arange(n)
    right_ones, all_ones = suffix(np.minimum(np.arange(n), major))[s], suffix(major)[s]
    straddling = np.array([(major[max(0, v - w) : v] >= v).sum() for v in s])
    all_ones = all_ones - straddling + np.minimum(w, s)
    all_zeros, right = n - all_ones, n - s
    right_zeros = right - right_ones
    with np.errstate(divide="ignore", invalid="ignore"):
        if score == "roc_auc":
            out = 0.5 * (1 + right_ones / all_ones - right_zeros / all_zeros)
            out[(all_ones == 0) | (all_zeros == 0)] = -np.inf
        else:
            f1 = lambda hit, truth, said: 2 * hit / (truth + said)
            out = 0.5 * (f1(right_ones, right, all_ones) + f1(s - (all_ones - right_ones), s, all_zeros))
    out = np.where(np.isfinite(out), out, -np.inf)
    out[(s < least) | (s >= n - least + w)] = -np.inf
    return out


def rank_sum_z(labels: np.ndarray, split: int) -> float:
    """Two-sided rank-sum statistic of votes left and right of the split (normal approximation, no tie correction)."""
    ones, zeros = int(labels.sum()), int((labels == 0).sum())
    ranks = np.where(labels == 1, zeros + (ones + 1) / 2, (zeros + 1) / 2)
    a, b = split, len(labels) - split
    return (ranks[:split].sum() - a * (a + b + 1) / 2) / math.sqrt(a * b * (a + b + 1) / 12)


def votes(offsets: np.ndarray, split: int, w: int) -> np.ndarray:
    k = offsets.shape[1]
    out = ((offsets >= split).sum(1) > k / 2).astype(int)
    out[max(0, split - w) : split] = 1
    return out


def arc_curve(nearest: np.ndarray) -> np.ndarray:
    """Corrected arc curve: arcs from each window to its nearest over each point, against those of random arcs; at most 1."""
    n = len(nearest)
    i = np.arange(n)
    events = np.bincount(np.minimum(i, nearest), minlength=n + 1) - np.bincount(np.maximum(i, nearest), minlength=n + 1)
    arcs = np.cumsum(events)[:n]
    ideal = 2 * i * (n - i) / n
    return np.minimum(np.divide(arcs, ideal, out=np.ones(n), where=ideal > 0), 1.0)
