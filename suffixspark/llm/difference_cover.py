"""Difference-cover (modulo 3) suffix sorting of one bucket, vectorised, to a bounded depth.

Suffixes at positions 1 and 2 modulo 3 are the sample. Their character triples are sorted and named, the names'
sequence is sorted by recursion, suffixes at positions 0 modulo 3 are sorted by (character, name of the next
sample), and both lists merge by comparisons that end at a sample position. A name at depth d covers 3**d
characters, so the recursion ends once that reaches the depth asked for; suffixes equal to that depth
then stand next to each other in no particular order.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s (integers from 1) ordered by their first ``depth`` values at least; a proper prefix comes first."""
    s = np.asarray(s, np.int64)
    if len(s) < 4:
        return np.array(sorted(range(len(s)), key=lambda i: s[i:].tolist()), np.int64)
    return _sort(s, int(s.max()) + 1, depth)


def _sort(s: np.ndarray, k: int, depth: int) -> np.ndarray:
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(4, np.int64)])
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    # With n = 1 mod 3 an all-zero triple at n joins the sample, so that every position 0 mod 3 has a successor in it.
    ones, twos = np.arange(1, 3 * n0, 3) if n0 > n1 else np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    keys = (t[sample] * k + t[sample + 1]) * k + t[sample + 2]
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.concatenate([[1], (sorted_keys[1:] != sorted_keys[:-1]).astype(np.int64)])
    named = np.cumsum(new)
    if named[-1] < len(sample) and depth > 3:
        names = np.empty(len(sample), np.int64)
        names[order] = named
        order = _sort(names, int(named[-1]) + 1, -(-depth // 3))
    by_rank = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]

    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] * (n + 4) + rank[zeros + 1])]
    # For each suffix 0 mod 3, how many sample suffixes come before it: those 1 mod 3 compare by one character and the rank
    # after it, those 2 mod 3 by two and the rank after them.
    width = n + 5
    one, two = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    low = np.searchsorted(t[one] * width + rank[one + 1], t[zeros] * width + rank[zeros + 1])
    pairs, pairs0 = t[two] * k + t[two + 1], t[zeros] * k + t[zeros + 1]
    if k * k * width >= 2**62:
        both = np.unique(np.concatenate([pairs, pairs0]), return_inverse=True)[1]
        pairs, pairs0 = both[: len(pairs)], both[len(pairs) :]
    low = low + np.searchsorted(pairs * width + rank[two + 2], pairs0 * width + rank[zeros + 2])
    at = np.maximum.accumulate(low) + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    is_zero = np.zeros(n, bool)
    is_zero[at] = True
    out[at] = zeros
    out[~is_zero] = by_rank
    return out


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes (by start) equal another window in these pieces.

    Windows end within their piece. The pieces, each with a 0 after it, make one text; in its suffix order equal
    windows are neighbours, so comparing adjacent prefixes finds all of them.
    """
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text = raw.astype(np.int64) + 2
    text[starts + sizes] = 1
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(raw))
    order = suffix_order(text, length)
    order = order[left[order] >= length]
    hit = np.zeros(len(raw), bool)
    # All windows as items of ``length`` bytes, compared in words.
    windows = np.ndarray((max(0, len(raw) - length + 1),), f"V{length}", raw, strides=(1,))
    word = next(w for w in (8, 4, 2, 1) if length % w == 0)
    for a in range(0, len(order) - 1, 4096):
        at = order[a : a + 4097]
        block = windows[at].view(f"u{word}").reshape(len(at), -1)
        same = (block[1:] == block[:-1]).all(axis=1)
        hit[at[1:][same]] = True
        hit[at[:-1][same]] = True
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(starts, sizes, strict=True)]
