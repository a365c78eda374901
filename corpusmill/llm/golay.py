"""The binary [23, 12, 7] Golay code, as tables for vectorised decoding.

The code is perfect: every 23-bit word has exactly one codeword within distance 3.  `keys` lists
the codewords within distance 4: one if the word is at most 2 away from its codeword, else six.
Two words that differ in at most 2 bits always share one of these codewords.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
BITS = 23


def _syndrome(word: int) -> int:
    for bit in range(BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits, of the high 11 bits, and each syndrome's error patterns of weight 4 or less."""
    low = np.array([_syndrome(i) for i in range(1 << 12)], dtype=np.int32)
    high = np.array([_syndrome(i << 12) for i in range(1 << 11)], dtype=np.int32)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            pattern = sum(1 << b for b in bits)
            found[int(low[pattern & 0xFFF] ^ high[pattern >> 12])].append(pattern)
    patterns = np.full((1 << 11, 6), -1, dtype=np.int64)
    for s, own in enumerate(found):
        patterns[s, : len(own)] = own
    return low, high, patterns


def keys(words: np.ndarray, made: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6) indices (12 bits) of the codewords within distance 4 of 23-bit words; -1 where there are fewer.  `made`: tables()."""
    low, high, patterns = made
    words = words.astype(np.int64)
    pattern = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    # the code is systematic in its high 12 bits
    return np.where(pattern < 0, -1, (words[:, None] ^ np.maximum(pattern, 0)) >> 11)
