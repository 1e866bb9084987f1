"""Polynomial prefix hashes over byte buffers: the hash of any substring in O(1), vectorised.

``prefix(data)`` gives P with P[i] = sum of table[data[j]] * B**j over j < i, modulo 2**64; the hash of
``data[s:e]`` is ``(P[e] - P[s]) * B**-s`` followed by a bit mixer, and so depends on the content alone.
B is odd, hence invertible; the 256 table values come from splitmix64. There are two such hashes, numbered 0 and 1, of
different bases and tables; both together are a name of 128 bits.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def splitmix64(n: int, seed: int = 0) -> np.ndarray:
    """The first n values of the splitmix64 sequence of a seed."""
    with np.errstate(over="ignore"):
        z = _U(seed) + _U(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=_U)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


_TABLES = tuple(splitmix64(256, seed) for seed in (7, 8))
#: For each hash, powers of its base and of the base's inverse.
_powers: list[list[np.ndarray]] = [[np.ones(1, _U), np.ones(1, _U)] for _ in _BASES]


def _grow(n: int, kind: int) -> None:
    size = 1 << max(10, int(n - 1).bit_length())
    if len(_powers[kind][0]) >= n:
        return
    with np.errstate(over="ignore"):
        for k, b in enumerate((_BASES[kind], pow(_BASES[kind], -1, 1 << 64))):
            out, step = np.ones(size, _U), 1
            while step < size:
                out[step : 2 * step] = out[:step] * _U(pow(b, step, 1 << 64))
                step *= 2
            _powers[kind][k] = out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(29)
        x *= _U(0xC2B2AE3D27D4EB4F)
        x ^= x >> _U(32)
    return x


def prefix(data: np.ndarray, kind: int = 0) -> np.ndarray:
    """Prefix sums of a uint8 array, one longer than it."""
    _grow(len(data) + 1, kind)
    out = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLES[kind][data] * _powers[kind][0][: len(data)], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hashes of data[start:end], uint64."""
    with np.errstate(over="ignore"):
        return mix((p[end] - p[start]) * _powers[kind][1][start])


def gram_hash(p: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte substrings, by start."""
    n = len(p) - k
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        return mix((p[k:] - p[:n]) * _powers[0][1][:n])
