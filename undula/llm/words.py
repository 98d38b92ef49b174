"""Words of many texts at once, hashed by NumPy without a Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k below n or more; base is odd."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(17, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                table[done : 2 * done] = table[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(table)
        _powers[base] = tuple(out)
    return _powers[base]


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of joined texts (see shared.joined), and the number of words before each text.
    A word ends at white space (space and \\t to \\r) or where its text ends."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = ends[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    stops = np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int = 1 << 17, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each word's bytes, made for some `most` bytes of words at a time; base (odd) decides which."""
    out = np.empty(len(starts), np.uint64)
    codes = _CODES if base == _BASE else mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    k = 0
    while k < len(starts):
        origin = starts[k]
        end = max(k + 1, int(np.searchsorted(stops, origin + most, "right")))
        part = data[origin : stops[end - 1]]
        up, down = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * up[: len(part)], out=total[1:])
        first, last = starts[k:end] - origin, stops[k:end] - origin
        value = (total[last] - total[first]) * down[first]
        out[k:end] = mix(value + (last - first).astype(np.uint64) * np.uint64(base))
        k = end
    return out


def grams(words: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """The hash of each n consecutive words, whatever text they are of; len(words) - n + 1 of them."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def sliding(values: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of each n consecutive values."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out
