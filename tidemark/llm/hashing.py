"""Vectorised hashes of words, word runs and byte strings of one text."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: One random long for each byte value.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype="uint64") | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, "uint64"), "down": np.ones(1, "uint64")}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i, modulo 2**64, for i < n."""
    if len(_powers["up"]) < n:
        for k, b in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(max(n, 1 << 16), b, "uint64")
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype="uint64")
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() takes the hash of any span of the bytes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, "uint64")
    np.cumsum(BYTE_CODES[data] * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that depend on the bytes alone."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(data)
    return span_hashes(prefix_sums(data), starts, ends) if len(starts) else np.empty(0, "uint64")


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; none if there are fewer."""
    if len(words) < n:
        return np.empty(0, "uint64")
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) + words[i : len(words) - n + 1 + i]
    return mix(out, n)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "uint8")
