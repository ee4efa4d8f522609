"""Content-defined anchors of long symbol sequences, in numpy.

A window of ``length`` symbols is owned by the leftmost of its k-grams of the
smallest hash. Equal windows own an equal k-gram at the same distance, so
everything that can be equal meets under one anchor, while an anchor owns about
half of ``length - k`` windows.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 22
_ROWS = 1 << 14


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k symbols (uint64 each); len - k + 1 of them.
    Runs of 1, 2, 4, ... symbols are joined by multiply-and-add."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, level, out, have, rest = symbols, 1, 0, None, 0, k
    while rest:
        if rest & size:
            part = power[have : have + n]
            if out is None:
                out = part.copy()
            else:
                out *= _STEP[level + 32]
                out += part
            have += size
            rest -= size
        if rest:
            longer = power[:-size] * _STEP[level]
            longer += power[size:]
            power = longer
            size *= 2
            level += 1
    return _mix(out)


def owners(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place) of each anchor: the runs of windows of
    ``width`` hashes that share their smallest, leftmost on ties."""
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    low, size = hashes, 1
    while size < width:
        shift = min(size, width - size)
        low = np.minimum(low[:-shift], low[shift:])
        size += shift
    # the owner changes where the minimum does, or where a window starts at its own minimum
    leaves = hashes[:n] == low
    first = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | leaves[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    place = last.copy()
    for at in range(0, len(first), _ROWS):
        some = np.arange(at, min(at + _ROWS, len(first)))
        some = some[~leaves[last[some]]]
        seen = hashes[last[some][:, None] + np.arange(width)] == low[last[some]][:, None]
        place[some] = last[some] + seen.argmax(axis=1)
    return first, last, place


def byte_symbols(data: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(data, np.uint8)]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of a UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    black = np.ones(len(raw) + 2, np.int8)
    black[0] = black[-1] = 0
    black[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff((black != 0).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_symbols(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # bounded slices of a very long text
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        s, e = starts[at:upto], ends[at:upto]
        sizes = e - s
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), _STEP[63], np.uint64))
        values = _BYTE[raw[np.repeat(s, sizes) + within]] * powers[within]
        out[at:upto] = np.add.reduceat(values, first)
        at = upto
    return _mix(out * _STEP[62])
