"""Hashed character and word n-gram counts of texts, for the classifiers."""

from __future__ import annotations

import numpy as np


def char_ngrams(text: str, sizes: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of a whole text's hashed character n-grams; weights are L2-normalised counts.

    The text is hashed in blocks, so memory follows the block and ``width``.
    """
    counts = np.zeros(width, np.float32)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    block, longest = 1 << 16, max(sizes)
    for at in range(0, len(code), block):
        part = code[at : at + block + longest - 1].astype(np.uint64)
        for n in sizes:
            size = min(block, len(part) - n + 1)
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            counts += np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width).astype(np.float32)
    index = np.flatnonzero(counts)
    weight = np.sqrt(counts[index])
    norm = float(np.linalg.norm(weight))
    return index, weight / norm if norm else weight
