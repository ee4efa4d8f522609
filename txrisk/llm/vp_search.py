"""Nearest neighbours by largest inner product over sharded vantage-point trees.

Inner products become Euclidean distances by one more coordinate,
sqrt(M^2 - |x|^2) with M the shard's largest norm, so the triangle inequality
holds. Each shard's tree is built once; blocks of queries visit its leaves in
the order of their lower bounds and stop once ``factor`` times the bound
exceeds the distance of the k-th found. Factor one is exact.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm._common import materialise

_RESULT = "query_id long, vec_id long, score double"


def build_tree(points: np.ndarray, leaf: int, seed: int = 0) -> dict[str, np.ndarray]:
    """A vantage-point tree in flat form: ``order`` of the points, ``ends`` of
    the leaves in it, ``vantage`` points, and for each leaf the path of
    (vantage number or -1, smallest, largest distance of the leaf's points)."""
    rng = np.random.default_rng(seed)
    vantage: list[int] = []
    order: list[np.ndarray] = []
    paths: list[list[tuple[int, float, float]]] = []
    todo = [(np.arange(len(points)), [])]
    while todo:
        index, path = todo.pop()
        if len(index) <= leaf:
            order.append(index)
            paths.append(path)
            continue
        point = int(index[rng.integers(len(index))])
        number = len(vantage)
        vantage.append(point)
        away = np.sqrt(((points[index] - points[point]) ** 2).sum(axis=1))
        ranked = np.argsort(away, kind="stable")  # split by rank: equal distances may fall on both sides
        half = len(index) // 2
        for side in (ranked[half:], ranked[:half]):
            bounds = (number, float(away[side[0]]), float(away[side[-1]]))
            todo.append((index[side], [*path, bounds]))
    depth = max(map(len, paths))
    node = np.full((len(paths), depth), -1, np.int64)
    low, high = np.zeros((len(paths), depth)), np.full((len(paths), depth), np.inf)
    for i, path in enumerate(paths):
        for j, (n, lo, hi) in enumerate(path):
            node[i, j], low[i, j], high[i, j] = n, lo, hi
    return {
        "order": np.concatenate(order), "ends": np.cumsum([len(o) for o in order]),
        "vantage": np.array(vantage, np.int64), "node": node, "low": low, "high": high,
    }


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that makes all norms equal."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0.0))[:, None]])


def search_tree(
    tree: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    k: int, factor: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each query found in this tree."""
    n = len(queries)
    points = lifted(vectors)
    radius2 = float((points[0] ** 2).sum())
    asked = np.hstack([queries, np.zeros((n, 1))])
    norms = np.einsum("ij,ij->i", queries, queries)
    bound = np.zeros((n, len(tree["ends"])))
    if len(tree["vantage"]):
        at = points[tree["vantage"]]
        away = np.sqrt(np.maximum(norms[:, None] + radius2 - 2 * asked @ at.T, 0.0))
        for j in range(tree["node"].shape[1]):
            node, real = tree["node"][:, j], tree["node"][:, j] >= 0
            d = away[:, node]
            gap = np.maximum(tree["low"][:, j] - d, d - tree["high"][:, j])
            np.maximum(bound, np.where(real, gap, 0.0), out=bound)
    ranked = np.argsort(bound, axis=1, kind="stable")
    starts = np.concatenate(([0], tree["ends"][:-1]))
    best_score, best_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    reach = np.full(n, np.inf)
    alive = np.arange(n)
    for r in range(bound.shape[1]):
        leaf = ranked[alive, r]
        near = factor * bound[alive, leaf] <= reach[alive] + 1e-9
        alive, leaf = alive[near], leaf[near]
        if not len(alive):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        for rows in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            who, one = alive[rows], leaf[rows[0]]
            members = tree["order"][starts[one] : tree["ends"][one]]
            rough = queries[who] @ vectors[members].T
            better = (rough >= best_score[who, k - 1][:, None] - 1e-9 * (1.0 + np.abs(rough))).any(axis=1)
            who = who[better]
            if not len(who):
                continue
            # einsum adds up each pair in the same order, so equal vectors tie exactly
            score = np.einsum("qd,ld->ql", queries[who], vectors[members])
            other = np.broadcast_to(ids[members], score.shape)
            score = np.where(other == query_ids[who][:, None], -np.inf, score)
            other = np.where(np.isneginf(score), np.iinfo(np.int64).max, other)
            score, other = np.hstack([best_score[who], score]), np.hstack([best_id[who], other])
            top = np.lexsort((other, -score), axis=-1)[:, :k]
            best_score[who], best_id[who] = np.take_along_axis(score, top, 1), np.take_along_axis(other, top, 1)
        worst = best_score[alive, k - 1]
        reach[alive] = np.where(
            np.isneginf(worst), np.inf, np.sqrt(np.maximum(norms[alive] + radius2 - 2 * np.maximum(worst, -1e300), 0.0))
        )
    found = ~np.isneginf(best_score)
    row, _ = np.nonzero(found)
    return row, best_id[found], best_score[found]


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as stored:
        return {name: stored[name] for name in stored.files}


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>, dim) of the rows that take part: no null
    id; the vector is not null, empty or zero and all components are finite.
    Rows that repeat id and vector count once."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    cast = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = cast.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return kept.dropDuplicates().withColumn("dim", F.size("vector"))


def build_index(rows: DataFrame, shard_rows: int = 8192, leaf: int = 128) -> DataFrame:
    """(dim, shard, tree): every usable row is indexed, about ``shard_rows`` a
    shard, so shards grow in number and not in size."""
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        vectors = np.stack(group["vector"].to_numpy())
        tree = build_tree(lifted(vectors), leaf)
        data = _pack(ids=group["vec_id"].to_numpy(np.int64), vectors=vectors, **tree)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [data]})

    return materialise(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, tree binary"), "vp-trees")


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = 4.0,
    shard_rows: int = 8192,
    leaf: int = 128,
    block_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products
    among ``rows`` (both as from ``usable``), rows of the query's own id left
    out, ties to the smaller id; all candidates if fewer than k.

    Vectors meet only vectors of as many components. Queries are dealt in
    blocks and every block meets every shard once. An empty side gives no rows.
    """
    index = build_index(rows, shard_rows, leaf)
    asked = materialise(queries, "queries")
    blocks = max(1, -(-asked.count() // block_rows))
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")).distinct()

    def collect(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        data = _pack(ids=group["vec_id"].to_numpy(np.int64), vectors=np.stack(group["vector"].to_numpy()))
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "asked": [data]})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    packed = dealt.groupBy("dim", "block").applyInPandas(collect, "dim int, block long, asked binary")
    packed = packed.join(shards, "dim")
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        tree, block = _unpack(left["tree"].iloc[0]), _unpack(right["asked"].iloc[0])
        row, ids, score = search_tree(
            tree, tree["ids"], tree["vectors"], block["ids"], block["vectors"], k, factor
        )
        return pd.DataFrame({"query_id": block["ids"][row], "vec_id": ids, "score": score})

    keys = ["dim", "shard", "block"]
    found = trees.groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInPandas(search, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
