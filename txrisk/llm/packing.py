"""Packing token pieces into sequences by best-fit decreasing.

Documents are tokenized and cut into full windows and a remainder. Pieces are
dealt over shards by a hash; in a shard, pieces go in decreasing length into
the open window that they fill most tightly, found by a segment tree indexed by
remaining capacity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokenizer pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PIECES = "doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    """Encoder of a byte-level BPE vocabulary file (JSON). As in that file, the
    strings of its special tokens stand for them, inside texts as well."""
    from txrisk.llm.token_alignment import byte_letters

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {token["content"]: token["id"] for token in held["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in entry): n for entry, n in held["model"]["vocab"].items() if entry not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open windows
    have each; ``tightest(n)`` is the smallest capacity of at least n that is
    held, or -1."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int:
        node, count = least + self.leaves, self.count
        if count[node]:
            return least
        while node > 1:  # up to the first held subtree on the right, then down its left edge
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not count[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; pieces are taken by decreasing
    length, ties in the order given. Every length is 1..capacity."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, held, opened = CapacityTree(capacity), [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.tightest(n) if n < capacity else -1
        if room < 0:
            w, room = opened, capacity
            opened += 1
        else:
            w = held[room].pop()
            tree.add(room, -1)
        window[i], offset[i] = w, capacity - room
        if room > n:
            held[room - n].append(w)
            tree.add(room - n, 1)
    return window, offset


def cut(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, copy_col: str | None = None
) -> DataFrame:
    """Pieces (doc_id, start, length, ids little-endian uint32, doc_tokens, copy):
    full windows of ``capacity`` and a remainder. Null text is empty: its piece
    is the end id alone. The strings of special tokens stand for those tokens.
    copy is 0 without ``copy_col``."""
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "copy"]

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_to_numpy
        for frame in frames:
            rows: list[tuple] = []
            size = 0
            for doc, text, copy in zip(frame["doc_id"].array, frame["text"].array, frame["copy"].array):
                ids = np.append(encode(text or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc, start, len(piece), piece.tobytes(), len(ids), copy))
                size += ids.nbytes
                if size > 16_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    id_type = docs.schema[id_col].dataType.simpleString()
    copy = F.lit(0) if copy_col is None else F.col(copy_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), copy.cast("long").alias("copy"))
    return source.mapInPandas(pieces, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, copy long")


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 0,
    docs_per_shard: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    copy_col: str | None = None,
) -> DataFrame:
    """All pieces with their place: doc_id, start, length, ids (binary, little-
    endian uint32), doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of the JSON vocabulary on every executor. Shards hold
    the pieces of about ``docs_per_shard`` documents, so their number grows
    with the input while a task's memory does not; pieces of a long document
    spread over shards, and so do the copies of a document that ``copy_col``
    numbers. A sequence_id is unique over all shards. Null and empty
    texts give one piece (the end id); a null id and repeated rows are packed
    like any other; an empty table gives no rows; other columns are ignored.
    """
    shards = max(1, -(-docs.count() // docs_per_shard))
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = cut(docs, vocabulary, capacity, end_id, id_col, text_col, copy_col)
    dealt = ["doc_id", "start"] if copy_col is None else ["doc_id", "start", "copy"]
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(*dealt), F.lit(shards))).drop("copy")

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start"], kind="stable", na_position="first")
        window, offset = best_fit_decreasing(frame["length"].to_numpy(np.int64), capacity)
        return frame.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + window, offset=offset)

    return pieces.groupBy("shard").applyInPandas(place, PIECES.format(id_type=id_type))
