"""Substring dedup on words by relative Lempel-Ziv parsing.

The contexts of a block are each other's reference: an index gives the earliest
place of every window of words. Each context is parsed greedily into factors
copied from earlier material; a factor of at least a window is a duplicate
span, and the windows across a factor's end are looked up again from there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm._common import words
from txrisk.llm.anchors import gram_hashes, word_bounds, word_symbols
from txrisk.llm.repeats import Unit, without_repeats


def index_windows(symbols: np.ndarray, owner_end: np.ndarray, length: int) -> np.ndarray:
    """The earliest place of the window that starts at each place (the place
    itself where no window fits)."""
    places = np.arange(len(symbols))
    earliest = places.copy()
    fits = np.flatnonzero(places + length <= owner_end)
    if not len(fits):
        return earliest
    hashes = gram_hashes(symbols, length)[fits]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = fits[order[np.flatnonzero(head)]]  # stable: the earliest of equal windows
    earliest[fits[order]] = first[np.cumsum(head) - 1]
    return earliest


def parse(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) of the duplicate factors. All
    contexts are parsed in step: one factor or one literal word each a round."""
    symbols = np.frombuffer(b"".join(contexts), np.uint64)
    sizes = np.array([len(c) // 8 for c in contexts], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    ends = np.repeat(end, sizes)
    earliest = index_windows(symbols, ends, length)
    who, first, last = [], [], []
    reader = np.arange(len(contexts))
    at = begin.copy()
    while len(reader):
        reader = reader[at[reader] + length <= end[reader]]
        place = at[reader]
        copied = earliest[place] < place
        at[reader[~copied]] += 1  # a literal
        factor = reader[copied]
        if not len(factor):
            continue
        start = at[factor]
        source = earliest[start]
        grown = np.full(len(factor), length)
        going = np.arange(len(factor))
        while len(going):  # as far as reference and text agree, within both contexts
            x, y = start[going] + grown[going], source[going] + grown[going]
            inside = (x < end[factor[going]]) & (y < ends[source[going]])
            going, x, y = going[inside], x[inside], y[inside]
            going = going[symbols[x] == symbols[y]]
            grown[going] += 1
        who.append(factor)
        first.append(start - begin[factor])
        last.append(start + grown - length - begin[factor])
        # windows across the factor's end may come from elsewhere
        at[factor] = start + grown - length + 1
    if not who:
        none = np.empty(0, np.int64)
        return none, none, none
    return np.concatenate(who), np.concatenate(first), np.concatenate(last)


def _words(data: bytes) -> np.ndarray:
    starts, ends = word_bounds(data)
    return word_symbols(data, starts, ends)


#: The windows of an anchor and its place in them are kept in eight bits each.
MAX_LENGTH = 250


def word_unit(length: int = 20) -> Unit:
    if not 1 <= length <= MAX_LENGTH:
        raise ValueError(f"length must be 1 to {MAX_LENGTH}, not {length}")
    return Unit(length, min(8, max(1, length // 2)), 8, _words, _words, parse)


def cut_words(data: bytes, spans: list) -> bytes:
    parts, kept, at = data.split(), [], 0
    for s in spans:
        kept += parts[at : s["start"]]
        at = s["end"]
    return b" ".join(kept + parts[at:])


def drop_repeated_words(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_symbols, spans, kept, kept_sha256).

    spans are the removed ranges of words: those covered by a window of
    ``length`` words whose sequence also starts earlier, in a smaller id or
    further ahead in the same text. kept is the other words joined by one space
    (binary UTF-8), null where nothing was removed. Null text has no words;
    shorter texts lose nothing; a null id counts as the smallest; rows that
    share an id but differ in text are ordered by a digest of it, rows equal in
    both count as copies of the first; texts that differ only in white space
    are different texts with equal words; an empty table gives no rows; other
    columns are ignored. A ``length`` outside 1 to 250 is refused.
    """
    said = words(F.col("text"))
    return without_repeats(docs, word_unit(length), cut_words, F.size(said), F.array_join(said, " "), id_col, text_col)
