"""Word and shingle hashes of whole texts in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  A word's
64-bit hash is a polynomial over randomised byte values, taken from one running sum
over the text; a shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

#: Longest piece of text hashed at once (longer only for a single longer word).
SEGMENT = 1 << 22
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed * 0x1000003))


_lower = np.arange(256)
_lower[65:91] += 32
_VALUE = constants(1, 256)[_lower]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(constants(2, 1)[0]) | 1
_STEP = constants(3, 64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[name] = have = np.multiply.accumulate(step)
    return have


def _segment_hashes(data: np.ndarray) -> np.ndarray:
    gap = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = not gap[0], not gap[-1]
    np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data), "up")[:len(data)], out=total[1:])
    back = _power(pow(_BASE, -1, 1 << 64), len(data), "down")
    return mix((total[end] - total[start]) * back[start])


def word_hashes(raw: bytes) -> np.ndarray:
    """One uint64 per word of the whole text, in order."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= SEGMENT:
        return _segment_hashes(data) if len(data) else np.empty(0, np.uint64)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            cut = np.flatnonzero(_SPACE[data[at:end]])
            while not len(cut) and end < len(data):  # one word longer than a segment
                end = min(len(data), end + SEGMENT)
                cut = np.flatnonzero(_SPACE[data[at:end]])
            if end < len(data) or len(cut):
                end = at + int(cut[-1]) + 1 if end < len(data) else end
        found.append(_segment_hashes(data[at:end]))
        at = end
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """One uint64 per run of k words; with fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out += words[j:n - width + 1 + j] * _STEP[j]
    return mix(out)


def shingle_set(raw: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(raw), k))
