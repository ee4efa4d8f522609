"""Substring dedup with a run-length compressed Burrows-Wheeler index.

In each block of contexts the transform is compressed to its runs, with the
text position sampled at both ends of every run. In text order, a position's
neighbour in the sorted suffixes follows from the last sample before it, and
its match length from that sample's length less the distance walked, so the
matching statistics of the whole block stream out of the samples alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.anchors import byte_symbols
from txrisk.llm.repeats import Unit, without_repeats


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by ranks of growing prefixes: 7 bytes to begin with, then
    three ranks side by side in one key (two, for a text too long for that)."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + 1, np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key * np.uint64(257) + padded[i : i + n]
    rank, step = _ranks(key), 7
    bits = int(n).bit_length()
    parts = 3 if 3 * bits <= 63 else 2
    while n and rank.max() < n - 1:
        later = np.concatenate([rank + 1, np.zeros(2 * step, np.int64)])  # 0: past the end
        key = later[:n]
        for i in range(1, parts):
            key = (key << bits) | later[i * step : i * step + n]
        rank = _ranks(key)
        step *= parts
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) if len(key) else order
    return rank


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of a byte array, with the text
    position sampled at the first and the last row of each run."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        tails = np.concatenate((heads[1:] - 1, [len(order) - 1]))
        self.text = text
        self.runs = before[heads]
        self.lengths = tails - heads + 1
        self._up = self._samples(order, heads, -1)
        self._down = self._samples(order, tails, +1)

    def _samples(self, order: np.ndarray, rows: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled text positions in order, with the position beside each in the
        sorted suffixes (-1: none) and their common length."""
        beside = rows + side
        inside = (beside >= 0) & (beside < len(order))
        at = order[rows]
        other = np.where(inside, order[np.clip(beside, 0, len(order) - 1)], -1)
        sort = np.argsort(at)
        at, other = at[sort], other[sort]
        return at, other, self._common(at, other)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, length = len(self.text), np.zeros(len(a), np.int64)
        going = np.flatnonzero(b >= 0)
        while len(going):
            x, y = a[going] + length[going], b[going] + length[going]
            fits = (x < n) & (y < n)
            going, x, y = going[fits], x[fits], y[fits]
            same = self.text[x] == self.text[y]
            going = going[same]
            length[going] += 1
        return length

    def statistics(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the sorted neighbour above and the one below: (position, match
        length) at each text position; a length of 0 has no position."""
        out = []
        everywhere = np.arange(len(self.text))
        for at, other, common in (self._up, self._down):
            last = np.searchsorted(at, everywhere, "right") - 1
            walked = everywhere - at[last]
            length = np.maximum(common[last] - walked, 0)
            out.append((np.where(length > 0, other[last] + walked, -1), length))
        return out


def long_matches(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) of the runs of windows of ``length``
    bytes whose string also starts earlier in the list of contexts."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), sizes)
    fits = np.arange(len(text)) + length <= (begin + sizes)[owner]
    far = len(text)
    earliest = np.where(fits, np.arange(len(text)), far)
    everywhere = np.arange(len(text))
    # windows of one string are neighbours in the sorted suffixes; the smallest
    # position on either side by doubling the links
    for position, matched in RunLengthIndex(text).statistics():
        link = np.where(matched >= length, position, everywhere)
        low = np.where(fits, everywhere, far)
        while True:
            low = np.minimum(low, low[link])
            onward = link[link]
            if np.array_equal(onward, link):
                break
            link = onward
        earliest = np.minimum(earliest, low)
    again = fits & (earliest < everywhere)
    at = np.flatnonzero(again)
    if not len(at):
        return at, at, at
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) > 0)) + 1
    first, last = at[np.concatenate(([0], cuts))], at[np.concatenate((cuts - 1, [len(at) - 1]))]
    return owner[first], first - begin[owner[first]], last - begin[owner[last]]


def _bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


#: The windows of an anchor and its place in them are kept in eight bits each.
MAX_LENGTH = 280


def byte_unit(length: int = 100) -> Unit:
    if not 1 <= length <= MAX_LENGTH:
        raise ValueError(f"length must be 1 to {MAX_LENGTH}, not {length}")
    gram = min(32, max(4, length // 3))
    return Unit(length, gram, 1, byte_symbols, _bytes, long_matches)


def cut_bytes(data: bytes, spans: list) -> bytes:
    kept, at = [], 0
    for s in spans:
        kept.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, data[at:]])


def drop_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_symbols, spans, kept, kept_sha256).

    spans are the maximal removed ranges of the UTF-8 bytes: those covered by a
    string of ``length`` bytes that also starts earlier, in a smaller id or
    further ahead in the same text. kept is what is left (binary), null where
    nothing was removed. Null text is empty; texts shorter than ``length`` lose
    nothing; a null id counts as the smallest; rows that share an id but differ
    in text are ordered by a digest of it, rows equal in both count as copies
    of the first; an empty table gives no rows; other columns are ignored.
    A ``length`` outside 1 to 280 is refused.
    """
    return without_repeats(docs, byte_unit(length), cut_bytes, F.octet_length("text"), F.col("text"), id_col, text_col)
