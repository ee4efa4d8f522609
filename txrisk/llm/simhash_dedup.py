"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``max_distance`` bits have a point
between them that is at most half that distance from each. Every distinct
fingerprint therefore emits all its variants within half the radius, and
fingerprints that emit the same variant collide. A full ball has 2,081
variants at radius 2, too many to write to shuffle files, so a fingerprint is
*routed* to the prefixes of its variants (37 for an 8-bit prefix) and the part
of the ball that lies under a prefix is enumerated there, in the task.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from txrisk.llm._common import materialise, unused
from txrisk.llm.components import connected_components

#: Variants that one task is meant to sort.
TASK_VARIANTS = 1 << 21
_SLICE = 1 << 16


def fingerprint_of(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text: lower-cased A-Z, words, shingles with
    repeats, XXH64 with seed 42; a bit is 1 if set in over half the hashes.
    Fewer words than a shingle: the whole sequence; no words: zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts])
    k = min(shingle, len(parts))
    starts = np.concatenate(([0], ends[: len(parts) - k])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        hashes = np.array(
            [digest(joined[s:e], 42) for s, e in zip(starts[at : at + _SLICE], stops[at : at + _SLICE])], "<u8"
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The SimHash of a text column as a (signed) long."""

    @pandas_udf("long")
    def fold(texts: pd.Series) -> pd.Series:
        made = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(made.view(np.int64))

    return fold(text)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4
) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint long, component_id).

    component_id is the smallest id reachable over links of at most
    ``max_distance`` differing bits, the row's own id included. Null and empty
    texts have fingerprint zero and are linked like any other; rows with equal
    text always share a component; a null id takes part in links but never
    becomes a component id unless no other is reachable; repeated ids keep a
    row each; an empty table gives no rows. Other columns are ignored.
    """
    prints = materialise(
        docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints"
    )
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    placed = _with_root(distinct, max_distance)
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _with_root(distinct: DataFrame, max_distance: int) -> DataFrame:
    """``distinct`` (one row per fp) plus root, the fingerprint that names the component."""
    roots = connected_components(close_links(distinct.select("fp"), max_distance))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return placed.withColumn("root", F.coalesce("root", "fp"))


def close_links(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all
    pairs of at most ``max_distance`` differing bits: a spanning forest of each
    prefix's collisions rather than every pair, so a group of n near copies
    gives O(n) rows. Colliding pairs are verified bit by bit before the forest
    is taken; a forest's link leads to the smallest member of its prefix."""
    wide, near = -(-max_distance // 2), max_distance // 2
    total = max(prints.count(), 1)
    ball = _ball(64, wide)
    bits = min(24, max(4, math.ceil(math.log2(total * ball / TASK_VARIANTS) + 1)))
    masks = [sum(1 << i for i in c) for r in range(wide + 1) for c in combinations(range(bits), r)]
    own = F.shiftrightunsigned(F.col("fp"), 64 - bits)
    targets = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: own.bitwiseXOR(m))
    routed = prints.select("fp", F.explode(targets).alias("part"))
    away = F.bit_count(own.bitwiseXOR(F.col("part")))
    sizes = F.lit(0)
    for d in range(wide + 1):
        sizes = F.when(away == d, F.lit(_ball(64 - bits, wide - d))).otherwise(sizes)
    # a prefix under which very many fingerprints lie is shared out by a hash of the variant
    loads = routed.groupBy("part").agg(F.sum(sizes.cast("long")).alias("load"))
    crowded = loads.where(F.col("load") > 2 * TASK_VARIANTS)
    crowded = crowded.select("part", F.ceil(F.col("load") / TASK_VARIANTS).cast("int").alias("shares"))
    dealt = routed.join(crowded, "part", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def collide(group: pd.DataFrame) -> pd.DataFrame:
        prints_here = np.unique(group["fp"].to_numpy(np.int64)).view(np.uint64)
        part, share, shares = (int(group[c].iloc[0]) for c in ("part", "share", "shares"))
        a, b = _collisions(prints_here, part, bits, wide, near, share, shares)
        keep = np.bitwise_count(prints_here[a] ^ prints_here[b]) <= max_distance
        root = local_roots(len(prints_here), a[keep], b[keep])
        tied = np.flatnonzero(root != np.arange(len(root)))
        signed = prints_here.view(np.int64)
        return pd.DataFrame({"a": signed[tied], "b": signed[root[tied]]})

    return dealt.groupBy("part", "share").applyInPandas(collide, "a long, b long").distinct()


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def _collisions(
    prints: np.ndarray, part: int, bits: int, wide: int, near: int, share: int, shares: int
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (center, member) of fingerprints that meet at a variant under
    the prefix ``part``. A center is within ``near`` of the variant, a member
    within ``wide``, so their distance is at most near + wide."""
    low = 64 - bits
    shift = np.uint64(low)
    away = np.bitwise_count((prints >> shift) ^ np.uint64(part))
    moved = (prints & np.uint64((1 << low) - 1)) | (np.uint64(part) << shift)
    variants, owners, steps = [], [], []
    for d in range(wide + 1):
        index = np.flatnonzero(away == d)
        for r in range(wide - d + 1):
            masks = np.array([sum(1 << i for i in c) for c in combinations(range(low), r)], np.uint64)
            stride = max(1, TASK_VARIANTS // max(1, len(masks)))
            for at in range(0, len(index), stride):
                some = index[at : at + stride]
                v = (moved[some][:, None] ^ masks).ravel()
                o = np.repeat(some.astype(np.int32), len(masks))
                if shares > 1:
                    mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shares) == share
                    v, o = v[mine], o[mine]
                variants.append(v)
                owners.append(o)
                steps.append(np.full(len(v), d + r, np.int8))
    v, o, s = np.concatenate(variants), np.concatenate(owners), np.concatenate(steps)
    ordered = np.sort(v)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(met):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(met, v), len(met) - 1)
    hit = met[slot] == v
    slot, o, s = slot[hit], o[hit], s[hit]
    center = np.full(len(met), len(prints), np.int64)
    np.minimum.at(center, slot[s <= near], o[s <= near])
    linked = center[slot] < len(prints)
    return center[slot[linked]], o[linked].astype(np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for links (a, b) among 0..n-1."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4
) -> DataFrame:
    """One row of each component stays, columns unchanged: that of the smallest
    id, null ids last; of rows that share this id, the one of the smallest
    digest of all columns, and one of rows equal in every column. Rows are
    numbered and written with their number, so ids may be null or repeated. Null
    and empty texts are one component; an empty table gives no rows."""
    row, fp = unused(docs, "row"), unused(docs, "fp")
    numbered = docs.withColumns({row: F.monotonically_increasing_id(), fp: fingerprint(F.col(f"`{text_col}`"), shingle)})
    numbered = materialise(numbered, "numbered")
    # null fields are left out of the JSON, so a digest names the columns that it covers
    digest = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256))
    order = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), digest.alias("digest"), F.col(row).alias("row"))
    distinct = numbered.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first"))
    distinct = materialise(distinct, "first-rows")
    keep = _with_root(distinct, max_distance).groupBy("root").agg(F.min("first").alias("first"))
    return numbered.join(keep.select(F.col("first.row").alias(row)), row, "left_semi").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
