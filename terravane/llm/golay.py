"""The perfect binary Golay code of length 23: nearest codewords, and all codewords within distance four.

Every 23-bit word lies within distance three of exactly one codeword. Words at distance three also have five
codewords at distance four; words nearer than that have none. So if two words differ in at most one bit, the
codeword nearest to the first is among the codewords within distance four of the second.
"""

from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS, GENERATOR = 23, 11, 0xC75


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder modulo the generator polynomial."""
    out = np.asarray(words, dtype=np.int64).copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        out ^= ((out >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return out


def _patterns() -> np.ndarray:
    """For each syndrome, the error patterns of weight four or less: the leader first, then five or none (-1)."""
    out = np.full((1 << CHECK_BITS, 6), -1, dtype=np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], dtype=np.int64)
        for s, error in zip(syndromes(errors).tolist(), errors.tolist()):
            out[s, int((out[s] >= 0).sum())] = error
    return out


PATTERNS = _patterns()


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the nearest codeword."""
    words = np.asarray(words, dtype=np.int64)
    return (words ^ PATTERNS[syndromes(words), 0]) >> CHECK_BITS


def nearby(words: np.ndarray) -> np.ndarray:
    """The indices of all codewords within distance four, six to a word, -1 where there are fewer."""
    words = np.asarray(words, dtype=np.int64)
    errors = PATTERNS[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)
