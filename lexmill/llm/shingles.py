"""Distinct word-shingle codes of many texts at once."""

from __future__ import annotations

import numpy as np

from lexmill.llm.common import mixed, word_codes

WIDTH = 5
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit codes of each text's `width`-word shingles, with A-Z lower-cased.

    A text of fewer words has one code for the whole sequence; one without words has none.
    """
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    codes = word_codes([w for words in split for w in words])
    n = max(0, len(codes) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled += codes[k : k + n] * ODD[k]
    rolled = mixed(rolled)
    out, start = [], 0
    for size in sizes.tolist():
        if size >= width:
            out.append(np.unique(rolled[start : start + size - width + 1]))
        elif size:
            short = codes[start : start + size]
            out.append(mixed((short * ODD[:size]).sum(dtype=np.uint64, keepdims=True) + np.uint64(size)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start += size
    return out
