"""Alignment of two tokenizers over the same bytes.

Both sides cut the same bytes. ``merge_asof``, keyed by document, finds for the
start of each token the token of the other side that covers it; both directions
together are all overlaps. A token that starts where its covering token starts
opens a group, so groups are cut where tokens of both sides end together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm._common import materialise
from txrisk.llm.packing import PATTERN

#: Text bytes aligned at once; a longer document is aligned by itself.
BYTES_AT_ONCE = 2_000_000
#: Id pairs with their counts are broadcast up to this many rows (a long key and two values each).
BROADCAST_PAIRS = 1_000_000
#: Groups whose tokens make more occurrence pairs than this are paired by distinct ids.
WIDE_GROUP = 256


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    Latin-1 stands for itself, the other bytes in order for the letters from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return letters


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """Encoder and token bytes of a byte-level BPE vocabulary file (JSON). Special
    tokens are left out, so their strings are plain text. Merges of such a
    vocabulary are ordered by id, which is what the encoder goes by."""
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in entry): number for entry, number in entries.items()}
    table = [b""] * (max(ranks.values()) + 1)
    for data, number in ranks.items():
        table[number] = data
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """Encoder and token bytes of a piece model: its space mark is a space, a byte entry its byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [
        bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
    ]
    return model, table


class Aligner:
    """Both tokenizers and the lookups made from their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        (a, self.a_bytes), (b, self.b_bytes) = byte_bpe(a_path), piece_bpe(b_path)
        self.encode_a: Callable = a.encode_to_numpy
        self.encode_b: Callable = lambda texts: b.encode(texts, num_threads=1)
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # a token in the written groups: its id and what follows it (same side, or the other side / the next group)
        self.written = [
            (np.array([f"{i}," for i in range(len(table))], object), np.array([f"{i}{end}" for i in range(len(table))], object))
            for table, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))
        ]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none on either where the bytes differ."""
        out = []
        none = np.empty(0, np.int64)
        for text, b in zip(texts, self.encode_b(texts)):
            data = b" " + text.encode()
            a = self.encode_a(" " + text, disallowed_special=()).astype(np.int64)
            same = b"".join(map(self.b_bytes.__getitem__, b)) == data and b"".join(map(self.a_bytes.__getitem__, a)) == data
            out.append((a, np.array(b, np.int64)) if text and same else (none, none))
        return out


def _laid_out(ids: list[np.ndarray], size: np.ndarray) -> pd.DataFrame:
    """One row per token: document, id, place of its first byte in the batch."""
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    start = np.concatenate(([0], np.cumsum(size[flat])))[:-1]
    return pd.DataFrame({"doc": doc, "id": flat, "start": start, "at": np.arange(len(flat))})


def covering(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """For the start of each token of ``a`` the token of ``b`` (``other``, ``other_start``) that covers it."""
    other = b[["doc", "start", "at"]].rename(columns={"at": "other"}).assign(other_start=b["start"])
    return pd.merge_asof(a, other, on="start", by="doc", direction="backward")


def pairs_of(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs (a << 32 | b) linked in a document and how often: every
    token of a group's one side with every token of its other side. ``a_cut``
    and ``b_cut`` are the first tokens of the groups and the end."""
    a_n, b_n = np.diff(a_cut), np.diff(b_cut)
    wide = a_n * b_n > WIDE_GROUP
    narrow_a, narrow_b = np.where(wide, 0, a_n), np.where(wide, 0, b_n)
    # each a token of a narrow group once per b token of the group
    each = np.repeat(narrow_b, a_n)
    left = np.repeat(a, each)
    first = np.repeat(np.repeat(b_cut[:-1], a_n), each)
    turn = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    keys, times = [left << 32 | b[first + turn]], [np.ones(len(left), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        x, nx = np.unique(a[a_cut[g] : a_cut[g + 1]], return_counts=True)
        y, ny = np.unique(b[b_cut[g] : b_cut[g + 1]], return_counts=True)
        keys.append((x[:, None] << 32 | y).ravel())
        times.append((nx[:, None] * ny).ravel())
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(times), len(key)).astype(np.int64)


def _aligned(aligner: Aligner, texts: list[str], keep: bool) -> list[tuple]:
    """Per text: n_a, n_b, n_groups, n_links, digest of the groups, pairs, times, groups, overlaps."""
    sides = aligner.tokens(texts)
    a, b = _laid_out([s[0] for s in sides], aligner.a_size), _laid_out([s[1] for s in sides], aligner.b_size)
    a_over, b_over = covering(a, b), covering(b, a)
    a_open = (a_over["other_start"] == a_over["start"]).to_numpy()
    b_open = (b_over["other_start"] == b_over["start"]).to_numpy()
    a_ids, b_ids = a["id"].to_numpy(), b["id"].to_numpy()
    # written order: the a tokens of a group, then its b tokens
    a_group, b_group = np.cumsum(a_open) - 1, np.cumsum(b_open) - 1
    a_first, b_first = np.append(np.flatnonzero(a_open), len(a)), np.append(np.flatnonzero(b_open), len(b))
    line = np.empty(len(a) + len(b), object)
    (a_more, a_end), (b_more, b_end) = aligner.written
    a_last, b_last = np.append(a_open[1:], True), np.append(b_open[1:], True)
    line[np.arange(len(a)) + b_first[a_group]] = np.where(a_last, a_end[a_ids], a_more[a_ids])
    line[np.arange(len(b)) + a_first[b_group + 1]] = np.where(b_last, b_end[b_ids], b_more[b_ids])
    a_doc = np.searchsorted(a["doc"].to_numpy(), np.arange(len(texts) + 1))
    b_doc = np.searchsorted(b["doc"].to_numpy(), np.arange(len(texts) + 1))
    a_cover, b_cover = a_over["other"].to_numpy(), b_over["other"].to_numpy()
    out = []
    for i in range(len(texts)):
        (a0, a1), (b0, b1) = a_doc[i : i + 2], b_doc[i : i + 2]
        if a0 == a1:
            out.append((0, 0, 0, 0, "", (), (), "", ()))
            continue
        cut_a = np.append(np.flatnonzero(a_open[a0:a1]), a1 - a0)
        cut_b = np.append(np.flatnonzero(b_open[b0:b1]), b1 - b0)
        groups = "".join(line[a0 + b0 : a1 + b1])[:-1]
        key, times = pairs_of(a_ids[a0:a1], b_ids[b0:b1], cut_a, cut_b)
        both = ()
        if keep:
            forth = zip(range(a1 - a0), (a_cover[a0:a1] - b0).tolist())
            back = zip((b_cover[b0:b1] - a0).tolist(), range(b1 - b0))
            both = [{"a": x, "b": y} for x, y in sorted({*forth, *back})]
        digest = hashlib.sha256(groups.encode()).hexdigest()
        out.append((a1 - a0, b1 - b0, len(cut_a) - 1, int(times.sum()), digest, key, times, groups if keep else None, both))
    return out


_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]


def _align_task(a_path: str, b_path: str, keep: bool):
    overlap = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def arrow(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        ends = pa.array(np.concatenate(([0], np.cumsum([len(f[5]) for f in found]))), pa.int32())
        lists = [
            pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *(np.asarray(f[c], np.int64) for f in found)])))
            for c in (5, 6)
        ]
        arrays = [ids, *[pa.array([f[c] for f in found], t) for c, (_, t) in enumerate(_FIELDS)], *lists]
        names = ["doc_id", *[n for n, _ in _FIELDS], "pairs", "times"]
        if keep:
            arrays += [pa.array([f[7] for f in found], pa.string()), pa.array([f[8] for f in found], overlap)]
            names += ["groups", "overlaps"]
        return pa.RecordBatch.from_arrays(arrays, names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            ids, texts, held, first = batch.column("doc_id"), [], 0, 0
            for at, text in enumerate(batch.column("text"), 1):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > BYTES_AT_ONCE or at == batch.num_rows:
                    yield arrow(ids.slice(first, at - first), _aligned(aligner, texts, keep))
                    texts, held, first = [], 0, at

    return align


def align(
    docs: DataFrame, a_path: str, b_path: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, one row per row.

    Side a is a byte-level BPE vocabulary (JSON) over a space and the text, side
    b a piece model over the text, which sets the space itself. ``pairs`` are
    the distinct id pairs (a << 32 | b) of tokens that share a group, ``times``
    how many occurrence pairs each has. With ``keep`` also ``groups``
    (a1,a2|b1;a3|b2) and ``overlaps`` (places of overlapping tokens).

    A text that is null or empty, or that either side does not give back byte
    by byte, has no tokens: zeros, empty lists and ''. Null ids and repeated
    rows are aligned like any other; an empty table gives no rows; other columns
    are ignored, whatever their names. A document's tokens are held by one task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    if keep:
        fields += ", groups string, overlaps array<struct<a:long,b:long>>"
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(_align_task(a_path, b_path, keep), fields)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs (rows that hold it linked), best (no pair of its a id has more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = materialise(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def link_statistics(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``align`` plus n_best (links whose pair is the commonest of its a id over
    all rows, ties included) and count_sum (over links, the rows that hold the pair).

    Pair counts are broadcast while there are at most ``broadcast_pairs`` of
    them; beyond that the documents' pairs are shuffled to them. Odd inputs as
    in ``align``; a row without tokens has zeros.
    """
    aligned = align(docs, a_path, b_path, False, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    aligned = materialise(aligned, "aligned")
    counts = materialise(pair_counts(aligned), "pair-weights")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    links = links.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")).join(counts, "pair")
    sums = links.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").select(
        *[c for c in aligned.columns if c != "row"],
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
    )
