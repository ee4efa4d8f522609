"""Ranked lexical search, reversed: items are indexed, documents are streamed.

A block of items becomes an inverted index (term -> items), which goes to all
tasks. Documents pass once to count the indexed terms and once, as term counts,
through the index, each task keeping a bounded heap per item. Heaps are merged
by rank. Scores are 64-bit integers, so no order of work changes them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm._common import materialise

#: Items and characters of their texts in one block of the index.
ITEMS_A_BLOCK, CHARS_A_BLOCK = 4096, 16_000_000
#: Cells of the score table (documents x items) worked on at once.
CELLS = 1 << 21
_KEPT = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: Bytes outside of terms become spaces, A-Z become a-z; UTF-8 of other characters stays.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b for b in _KEPT)


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass
class ItemIndex:
    """Terms of a block's items, and per term the items (by place) that hold it."""

    number: dict[bytes, int]
    start: np.ndarray
    items: np.ndarray
    ids: list

    @staticmethod
    def build(rows: list[tuple]) -> ItemIndex:
        number: dict[bytes, int] = {}
        holders: list[list[int]] = []
        for place, (_, text) in enumerate(rows):
            for term in sorted(set(terms(text))):
                at = number.setdefault(term, len(number))
                if at == len(holders):
                    holders.append([])
                holders[at].append(place)
        start = np.concatenate(([0], np.cumsum([len(h) for h in holders], dtype=np.int64))).astype(np.int64)
        items = np.array([p for h in holders for p in h], np.int64)
        return ItemIndex(number, start, items, [r[0] for r in rows])


def term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts (of the indexed ones) per document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.value.number.get
        for batch in batches:
            ids, sizes, found, times, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held = terms(text.as_py())
                if not held:
                    continue
                known = np.fromiter((t for t in map(get, held) if t is not None), np.int32)
                which, often = np.unique(known, return_counts=True)
                ids.append(doc)
                sizes.append(len(held))
                found.append(which)
                times.append(often)
                ends.append(ends[-1] + len(which))
            ends_ = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends_, pa.array(np.concatenate([*found, np.empty(0, np.int32)]).astype(np.int32))),
                    pa.ListArray.from_arrays(ends_, pa.array(np.concatenate([*times, np.empty(0, np.int64)]).astype(np.int64))),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")


class Heaps:
    """The ``k`` best documents of each item: higher score, then smaller id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.best = k, [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, np.int64)

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores``: documents x items; a score of 0 never enters."""
        floor = self.floor
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        for row, item in np.argwhere(scores >= floor).tolist():
            entry = (int(scores[row, item]), -math.inf if ids[row] is None else -ids[row])
            heap = self.best[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]


def _through(index, weights, n_docs: int, n_terms: int, k: int):
    """Term counts through the index into heaps, which are given out at the end of the task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, w = index.value, weights.value
        heaps = Heaps(len(idx.ids), k)
        step = max(1, CELLS // max(1, len(idx.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.column("n").to_numpy()
                m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
                held, often = part.column("terms"), part.column("counts").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy()))
                term = held.flatten().to_numpy()
                gain = w[term] * ((1_000_000_000 * often) // (1000 * often + 8 * m[row]))
                order = np.argsort(term, kind="stable")
                term, row, gain = term[order], row[order], gain[order]
                cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
                scores = np.zeros((part.num_rows, len(idx.ids)), np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    t = int(term[a])
                    scores[row[a:b, None], idx.items[idx.start[t] : idx.start[t + 1]]] += gain[a:b, None]
                heaps.offer(scores, part.column("doc_id").to_pylist())
        found = [(i, None if neg == -math.inf else -neg, s) for i, h in enumerate(heaps.best) for s, neg in h]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["place", "doc_id", "score"]
        )

    return search


def _search_block(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    index = sc.broadcast(ItemIndex.build(rows))
    counts = materialise(term_counts(docs, index), "term-counts")
    total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weight = np.zeros(len(index.value.number), np.int64)  # one entry per indexed term of the block
    for term, df in held:
        weight[term] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * df + 1)))
    search = _through(index, sc.broadcast(weight), total["n"], total["l"] or 1, k)
    heaps = counts.mapInArrow(search, "place long, doc_id long, score long")
    best = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    item_type = "item_id long, place long"
    items = docs.sparkSession.createDataFrame([(r, i) for i, r in enumerate(index.value.ids)], item_type)
    return ranked.join(F.broadcast(items), "place").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    items_a_block: int = ITEMS_A_BLOCK,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents of score above 0.

    Weights, lengths and counts are those of the whole table. Items go through
    in blocks of about ``items_a_block`` rows, each block against all documents.
    Ids are integers. Null and empty texts have no terms: such a document is
    not counted and never found, such an item finds nothing. Ties go to the
    smaller id, null ids last; repeated documents are ranked one by one and
    repeated items are answered one by one; an empty table on either side gives
    no rows; other columns are ignored, whatever their names. Nothing is
    cut off a document or an item.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // items_a_block), -(-(size["chars"] or 0) // CHARS_A_BLOCK))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = [tuple(r) for r in items.where(block == b).orderBy("item_id", "text").collect()]
        part = _search_block(docs, rows, k)
        found = part if found is None else found.unionByName(part)
    return found
