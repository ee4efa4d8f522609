"""Repeated windows across a corpus: shared machinery of the substring operators.

1. Every document emits its anchors (anchors.py); anchors that occur once are
   settled, their windows are unique.
2. The context of each other anchor (the symbols of the windows it owns) gets a
   class: equal contexts. All but a class's first occurrence are repeats whole.
3. The first occurrences of an anchor's classes meet in a block, where the
   operator's own index (a run-length BWT, or relative Lempel-Ziv references)
   finds which of their windows start earlier elsewhere.

Copies of a whole text are represented by the first of them throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm._common import materialise
from txrisk.llm.anchors import gram_hashes, owners

#: Classes that one block is meant to hold.
BLOCK_CLASSES = 1_500
#: An anchor of more classes than this is compared window by window in Spark.
CROWDED_CLASSES = 200_000


@dataclass(frozen=True)
class Unit:
    """How a text is read. ``symbols`` gives uint64 symbols, ``context`` what a
    range of them is sent as (``width`` bytes a symbol)."""

    length: int
    gram: int
    width: int
    symbols: Callable[[bytes], np.ndarray]
    context: Callable[[bytes], np.ndarray]
    #: of the contexts of one block, in order of occurrence: (class, first window, last window) of the runs of
    #: windows that also start earlier
    solve: Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: Anchors that a task gathers before it sends them.
_GATHER = 200_000


def _anchor_rows(unit: Unit) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (route, anchor, key, place, known). Anchors that a task meets twice
    are known to be shared: it sends their rows by another route, spread out,
    and one row without a place that speaks for all of them. An anchor has one
    row a gathering at most, however often it occurs."""

    def send(parts: list[tuple]) -> pd.DataFrame:
        anchor, key, place = (np.concatenate(c) for c in zip(*parts))
        _, number, count = np.unique(anchor, return_inverse=True, return_counts=True)
        known = count[number] > 1
        spread = (key * np.int64(-7046029254386353131)) ^ (place * np.int64(0x2545F4914F6CDD1D))
        rows = pd.DataFrame({"route": np.where(known, spread, anchor), "anchor": anchor, "key": key, "place": place, "known": known})
        spoken = np.unique(anchor[known])
        notes = pd.DataFrame({"route": spoken, "anchor": spoken, "key": 0, "place": -1, "known": False})
        return pd.concat([rows, notes], ignore_index=True)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for frame in frames:
            for key, data in zip(frame["key"].to_numpy(np.int64), frame["data"].array):
                found = anchors_of(unit.symbols(data), unit.length, unit.gram)
                if found is None:
                    continue
                hashes, first, last, at = found
                packed = (first << 16) | ((last - first) << 8) | (at - first)
                parts.append((hashes.view(np.int64), np.full(len(first), key), packed))
                size += len(first)
                if size > _GATHER:
                    yield send(parts)
                    parts, size = [], 0
        if parts:
            yield send(parts)

    return emit


def anchors_of(symbols: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(hash, first window, last window, place) of each anchor, or None if the
    sequence is shorter than a window."""
    hashes = gram_hashes(symbols, gram)
    first, last, at = owners(hashes, length - gram + 1)
    return (hashes[at], first, last, at) if len(first) else None


def _context_rows(unit: Unit) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        names = ["anchor", "class", "doc", "key", "start", "windows", "context"]
        for frame in frames:
            rows, seen, size = [], set(), 0
            for doc, key, data, places, hashes in zip(
                frame["doc"].array, frame["key"].array, frame["data"].array, frame["places"].array, frame["hashes"].array
            ):
                whole = unit.context(data).tobytes()
                for place, anchor in zip(places.tolist(), hashes.tolist()):
                    first, more = place >> 16, (place >> 8) & 255
                    context = whole[first * unit.width : (first + more + unit.length) * unit.width]
                    kind = digest(context) - (1 << 63)
                    sent = None if (anchor, kind) in seen else context
                    seen.add((anchor, kind))
                    size += len(context) if sent else 64
                    rows.append((anchor, kind, doc, key, first, more + 1, sent))
                if size > 16_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, seen, size = [], set(), 0
            yield pd.DataFrame(rows, columns=names)

    return emit


def repeated_spans(docs: DataFrame, unit: Unit, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, spans).

    texts: one row per distinct text, (sha, key, doc): its digest, a 64-bit key
    and the smallest id that has it. spans: (doc, key, start, end) in symbols,
    end exclusive, of windows that also start earlier in the order of (doc, key,
    start); null ids come first. Spans overlap.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc"), data.alias("data")).withColumn("key", F.xxhash64("data"))
    id_type = dict(rows.dtypes)["doc"]

    listed = rows.select(F.sha2("data", 256).alias("sha"), "key", "doc")
    # min() passes over null, and null ids come first
    texts = materialise(listed.groupBy("sha", "key").agg(F.min(F.struct("doc"))["doc"].alias("doc")), "texts")

    schema = "route long, anchor long, key long, place long, known boolean"
    placed = rows.select("key", "data").mapInPandas(_anchor_rows(unit), schema)
    shared = F.col("known") | (F.count("*").over(Window.partitionBy("route")) > 1)
    live = placed.withColumn("shared", shared).where("shared and place >= 0").select("key", "anchor", "place")
    lists = live.groupBy("key").agg(F.collect_set(F.struct("place", "anchor")).alias("a"))
    lists = materialise(lists.select("key", F.col("a.place").alias("places"), F.col("a.anchor").alias("hashes")), "anchors")

    wanted = lists.join(texts.select("key", F.col("doc").alias("rep")), "key")
    chosen = rows.join(wanted, (rows["key"] == wanted["key"]) & rows["doc"].eqNullSafe(wanted["rep"]))
    chosen = chosen.select("doc", rows["key"], "data", "places", "hashes")
    schema = f"anchor long, class long, doc {id_type}, key long, start long, windows int, context binary"
    seen = materialise(chosen.mapInPandas(_context_rows(unit), schema), "contexts")

    classes = seen.groupBy("anchor", "class").agg(
        F.min(F.struct("doc", "key", "start")).alias("first"),
        F.max("windows").alias("windows"),
        F.max("context").alias("context"),
    )
    classes = materialise(classes, "classes")
    again = seen.drop("context", "windows").withColumn("at", F.struct("doc", "key", "start"))
    again = again.join(classes.select("anchor", "class", "first", "windows"), ["anchor", "class"])
    again = again.where(~F.col("at").eqNullSafe(F.col("first")))
    spans = again.select("doc", "key", "start", (F.col("start") + F.col("windows") + unit.length - 1).alias("end"))
    return texts, spans.unionByName(_solved(classes, unit, id_type))


def _solved(classes: DataFrame, unit: Unit, id_type: str) -> DataFrame:
    """Spans of the classes' first occurrences whose windows start earlier in another class."""
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("n"))
    total = sizes.where("n > 1").agg(F.sum("n"), F.max("n")).first()
    blocks = max(1, -(-(total[0] or 0) // BLOCK_CLASSES))
    meeting = classes.join(sizes.where(f"n > 1 and n <= {CROWDED_CLASSES}"), "anchor")
    meeting = meeting.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).select("block", "anchor", "first.*", "context")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc", "key", "start"], na_position="first", kind="stable", ignore_index=True)
        who, first, last = unit.solve(list(group["context"]), unit.length)
        start = group["start"].to_numpy(np.int64)[who]
        found = group.loc[who, ["doc", "key"]].reset_index(drop=True)
        return found.assign(start=start + first, end=start + last + unit.length)

    schema = f"doc {id_type}, key long, start long, end long"
    solved = meeting.groupBy("block").applyInPandas(solve, schema)
    if (total[1] or 0) > CROWDED_CLASSES:
        crowded = classes.join(sizes.where(f"n > {CROWDED_CLASSES}").select("anchor"), "anchor")
        solved = solved.unionByName(_by_window(crowded, unit))
    return solved


def _by_window(classes: DataFrame, unit: Unit) -> DataFrame:
    """The exact way for anchors of very many classes: each window is a row, its
    earliest start a map-side combined minimum."""
    at = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
    each = classes.select("anchor", "first", "context", at.alias("i"))
    window = F.substr("context", F.col("i") * unit.width + 1, F.lit(unit.length * unit.width))
    each = each.select(
        F.sha2(window, 256).alias("w"),
        F.col("first.doc").alias("doc"), F.col("first.key").alias("key"), (F.col("first.start") + F.col("i")).alias("start"),
    )
    early = each.groupBy("w").agg(F.min(F.struct("doc", "key", "start")).alias("early"))
    later = each.join(early, "w").where(~F.struct("doc", "key", "start").eqNullSafe(F.col("early")))
    return later.select("doc", "key", "start", (F.col("start") + unit.length).alias("end"))


def merged(spans: DataFrame) -> DataFrame:
    """(doc, key, spans): each text's spans as ordered disjoint array<struct<start,end>>."""
    listed = spans.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def join(lists: pd.Series) -> pd.Series:
        return lists.map(_join_spans)

    return listed.select("doc", "key", join("spans").alias("spans"))


def _join_spans(spans) -> list[dict]:
    out: list[dict] = []
    for s in spans:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def without_repeats(
    docs: DataFrame, unit: Unit, cut: Callable[[bytes, list], bytes], size: Column, whole: Column,
    id_col: str, text_col: str,
) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_symbols, spans, kept binary or
    null, kept_sha256). kept is null for a text that lost nothing. ``size`` and
    ``whole`` give the number of symbols and the kept form of an untouched text
    held in a column named ``text``."""
    texts, spans = repeated_spans(docs, unit, id_col, text_col)
    # the id as a long or as given; equal ids with equal texts are told apart below
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc"), data.alias("data"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("data"))
    joined = materialise(merged(spans), "spans")

    @F.pandas_udf("binary")
    def remove(datas: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([cut(d, s) for d, s in zip(datas, lists)])

    hit = joined.select(F.col("doc").alias("rep"), F.col("key").alias("rep_key"), "spans")
    cut_rows = rows.join(hit, rows["doc"].eqNullSafe(hit["rep"]) & (rows["key"] == hit["rep_key"]))
    cut_rows = cut_rows.select("doc", "key", "spans", remove("data", "spans").alias("kept"))
    cut_rows = cut_rows.dropDuplicates(["doc", "key"]).select(
        F.col("doc").alias("rep"), F.col("key").alias("rep_key"), "spans", "kept", F.sha2("kept", 256).alias("kept_sha")
    )
    # every row against its text: the first row of a text is that text, others are copies
    listed = rows.select(
        "doc", "key", F.sha2("data", 256).alias("sha"), size.cast("long").alias("n_symbols"), F.sha2(whole, 256).alias("whole_sha")
    )
    counted = listed.groupBy("doc", "sha", "key").agg(
        F.count("*").alias("rows"), F.first("n_symbols").alias("n_symbols"), F.first("whole_sha").alias("whole_sha")
    )
    known = texts.select(F.col("sha").alias("of"), F.col("doc").alias("first_doc"))
    counted = counted.join(known, counted["sha"] == known["of"]).withColumn("lead", F.col("doc").eqNullSafe(F.col("first_doc")))
    counted = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    counted = counted.withColumn("copy", ~F.col("lead") | (F.col("nth") > 1))
    out = counted.join(
        cut_rows, ~F.col("copy") & counted["doc"].eqNullSafe(cut_rows["rep"]) & (counted["key"] == cut_rows["rep_key"]), "left"
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_symbols").alias("end")))
    gone = F.col("copy") & (F.col("n_symbols") >= unit.length)
    empty = F.lit(b"")
    return out.select(
        F.col("doc").alias(id_col),
        "n_symbols",
        F.when(gone, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, empty).otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.sha2(empty, 256)).otherwise(F.coalesce("kept_sha", "whole_sha")).alias("kept_sha256"),
    )
