"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .quality import _is_space, _power, _prefix_hashes, mixed, points

WORDS = 5


def lowered(chars: np.ndarray) -> np.ndarray:
    """A-Z in lower case, nothing else."""
    return np.where((chars >= 65) & (chars <= 90), chars + 32, chars)


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles. With fewer words than `size`, the whole sequence is
    one shingle; without words the set is empty."""
    chars, bounds = points(texts)
    chars = lowered(chars)
    word = ~_is_space(chars)
    begins = word.copy()
    if len(chars):
        begins[1:] &= ~word[:-1]
        inner = bounds[1:-1][bounds[1:-1] < len(chars)]
        begins[inner] = word[inner]
    first = np.append(0, np.cumsum(begins))[bounds]
    start = np.nonzero(begins)[0]
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    sums = _prefix_hashes(np.where(word, mixed(chars.astype(np.uint64) + np.uint64(1)), np.uint64(0)))
    hashes = mixed((sums[np.append(start[1:], len(chars))] - sums[start]) * _power(len(chars) + 1)[1][start])
    sums = _prefix_hashes(hashes)
    inverse = _power(len(hashes) + 1)[1]
    n = len(hashes) - size + 1
    windows = mixed((sums[size : size + n] - sums[:n]) * inverse[:n] + np.uint64(size)) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(mixed((sums[b : b + 1] - sums[a : a + 1]) * inverse[a : a + 1] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
