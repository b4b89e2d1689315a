"""Word-shingle sets as sorted 64-bit hashes, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint64)
IS_SPACE = np.isin(_BYTES, [32, *range(9, 14)])
IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
with np.errstate(over="ignore"):
    LETTER = mix(np.where(IS_UPPER, _BYTES + np.uint64(32), _BYTES) + _A)
    #: Odd multipliers of the places in a word; places repeat after so many bytes.
    _PLACE = mix(np.arange(1, 4_097, dtype=np.uint64)) | np.uint64(1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, the byte after it, and the first byte of the latest word for every byte.

    ``data`` begins and ends with white space.
    """
    space = IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return starts, ends, np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))


def word_sums(letters: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words: sums of letter times place over each word's bytes, as differences of one running sum."""
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _PLACE[place % len(_PLACE)])])
        return mix(running[ends] - running[starts])


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case."""
    data = np.frombuffer(b"\n" + (text or "").encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    starts, ends, begin = word_bounds(data)
    return word_sums(LETTER[data], np.arange(len(data)) - begin, starts, ends)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter; empty without words."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    width = min(size, n)
    with np.errstate(over="ignore"):
        s = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            s = mix(s * _A + h[i : n - width + 1 + i] * _B + _C)
    return np.unique(s)


def fingerprint(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set, as a signed integer."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)
