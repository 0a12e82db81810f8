"""Vectorised 64-bit hashes of byte windows and words.  All arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time: arrays of eight bytes for each stay in cache or near it.
CHUNK = 1 << 18

#: A second hash with another base and another table, for fingerprints of 128 bits.
_BASES = (_BASE, np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_TABLES = (_TABLE, np.random.Generator(np.random.PCG64(20250307)).integers(0, 1 << 64, 256, dtype=np.uint64))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + 4096)
        up, down = np.full(size, _BASES[which], np.uint64), np.full(size, _INVERSES[which], np.uint64)
        up[0] = down[0] = 1
        have = _powers[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of table[byte] * base**i before each position; :func:`between` reads windows from them."""
    up, _ = powers(len(data), which)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_TABLES[which][data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the windows [start, end), the same wherever a window stands."""
    _, down = powers(len(sums), which)
    return (sums[end] - sums[start]) * down[start]


def _words_of_chunk(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return mix(between(prefix(data), start, end) + (end - start).astype(np.uint64) * _STEP)


def words(raw: bytes) -> np.ndarray:
    """Hashes of the words (between ASCII white space) of a whole text, in order."""
    data = np.frombuffer(raw, np.uint8)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:  # a word isn't cut
            ahead = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + CHUNK)
        parts.append(_words_of_chunk(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of all words together where there are fewer."""
    n = len(word_hashes)
    size = min(size, n)
    if not n:
        return np.empty(0, np.uint64)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = out * _STEP + word_hashes[k : n - size + 1 + k]
    return mix(out + np.uint64(size))
