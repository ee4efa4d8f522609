"""E6 PageRank (weighted) and E7 betweenness (weighted; exact, or from pivots).

PageRank is a driver loop over DataFrames: each round is one join of the state
with the edge table and one aggregation. So is betweenness where many edges lead
on from a node that receives; where they are few, they are broadcast, and each task
follows the paths of its own pivots in one pass. PageRank's state is persisted per
round and reliably checkpointed every few rounds, betweenness' every round
(``spark.checkpoint.dir``), so lineage stays short and a lost executor only
recomputes from the last checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.distributed import checkpointed, running_totals

PR_ALPHA = 0.85
PR_MAX_ITER = 100
PR_TOL = 1e-6
CHECKPOINT_EVERY = 5


def pagerank(
    e: DataFrame,
    node_df: DataFrame,
    alpha: float = PR_ALPHA,
    iterations: int | None = None,
    max_iter: int = PR_MAX_ITER,
    tol: float = PR_TOL,
    checkpoint_every: int = CHECKPOINT_EVERY,
    scale_tol: bool = False,
) -> DataFrame:
    """Weighted PageRank (weight = amount), uniform teleport; the mass of
    dangling nodes (zero total out-weight) is spread uniformly.

    ``iterations`` given: exactly that many power steps. Otherwise iterate
    until the L1 change is below ``tol`` (``scale_tol``: below n * tol, the
    looser form whose meaning depends on the number of nodes); fail after
    ``max_iter`` steps. The state is checkpointed every ``checkpoint_every``
    rounds, and the checkpoint before is dropped."""
    n = node_df.count()
    if n == 0:
        return node_df.select("account", F.lit(0.0).alias("pagerank"))
    wout = e.groupBy("src").agg(F.sum("amount").alias("_wout")).where(F.col("_wout") != 0)
    # edges and flags are written once; joins stay open to run-time skew splitting
    en = checkpointed(e.join(wout, "src").select("src", "dst", (F.col("amount") / F.col("_wout")).alias("w")))
    flags = checkpointed(
        node_df.select("account")
        .join(wout.select(F.col("src").alias("account"), F.lit(False).alias("_has_out")), "account", "left")
        .join(en.select(F.col("dst").alias("account"), F.lit(True).alias("_has_in")).distinct(), "account", "left")
        .select("account", F.col("_has_out").isNull().alias("dangling"), F.col("_has_in").isNotNull().alias("receives"))
    )
    # nodes without incoming edges all have one value: what they send is a number a receiver, worked out once
    sent = en.join(flags.select(F.col("account").alias("src"), "receives"), "src")
    core = checkpointed(sent.where("receives").select("src", "dst", "w"))
    fixed = sent.where(~F.col("receives")).groupBy(F.col("dst").alias("account")).agg(F.sum("w").alias("_w"))
    x = checkpointed(
        flags.where("receives").join(fixed, "account", "left").select(
            "account", "dangling", F.coalesce("_w", F.lit(0.0)).alias("_fixed"), F.lit(1.0 / n).alias("x")
        )
    )
    alone, alone_dangling, dangling = flags.agg(
        F.count_if(~F.col("receives")), F.count_if(~F.col("receives") & F.col("dangling")), F.count_if(F.col("dangling"))
    ).first()
    plain, mass = 1.0 / n, dangling / n
    held = None
    converged = iterations is not None
    for it in range(1, (iterations if iterations is not None else max_iter) + 1):
        contrib = (
            x.join(core, x.account == core.src)
            .groupBy(F.col("dst").alias("account"))
            .agg(F.sum(F.col("x") * F.col("w")).alias("_c"))
        )
        base = alpha * mass / n + (1.0 - alpha) / n
        old = x.select("account", "dangling", "_fixed", F.col("x").alias("_old"))
        got = F.coalesce("_c", F.lit(0.0)) + F.col("_fixed") * F.lit(plain)
        state = old.join(contrib, "account", "left").select(
            "account", "dangling", "_fixed", (F.lit(alpha) * got + F.lit(base)).alias("x"), "_old"
        ).persist()
        # one job a round: fills the cache, gives the change and the next dangling mass
        moved, mass = state.agg(
            F.coalesce(F.sum(F.abs(F.col("x") - F.col("_old"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0)),
        ).first()
        moved, mass, plain = moved + alone * abs(base - plain), mass + alone_dangling * base, base
        x = state.drop("_old")
        if it % checkpoint_every == 0:
            x = checkpointed(x)
            state.unpersist()
            state = None
        if held is not None:
            held.unpersist()
        held = state
        if iterations is None and moved < (n * tol if scale_tol else tol):
            converged = True
            break
    if not converged:
        raise RuntimeError(f"pagerank did not converge in {max_iter} iterations")
    return flags.join(x.select("account", "x"), "account", "left").select(
        "account", F.when(F.col("receives"), F.col("x")).otherwise(F.lit(plain)).alias("pagerank")
    )


PIVOTS_A_CHUNK = 500
#: (pivot, edge) rows that a round of a chunk may pass, all tasks together.
ROWS_A_CHUNK = 50_000_000
#: Edges behind the first one of a path (those of nodes that receive) up to which they are broadcast.
CORE_EDGES = 1_000_000
#: (edge, pivot) pairs that a task works on at once, and all in all.
PAIRS_A_BLOCK, PAIRS_A_TASK = 320_000, 1_000_000_000


def ranked_pivots(node_df: DataFrame, seed: int = 42) -> DataFrame:
    """All nodes (account) with their ``rank`` from 0 in a seeded hash order: the
    first k are a random draw of k nodes. Ranked by value ranges, so the order
    never passes one task or the driver."""
    h = F.md5(F.concat_ws("|", F.col("account"), F.lit(str(seed))))
    hashed = node_df.select("account", h.alias("_h"), F.lit(1.0).alias("_one"))
    ranked = running_totals(hashed, [("_h", True), ("account", True)], ["_one"])
    return ranked.select("account", (F.col("cum__one").cast("long") - 1).alias("rank"))


def sampling_error(variance: float, k: int, n: int, failure: float) -> float:
    """Empirical Bernstein-Serfling bound: a mean of k values in [0, 1], drawn
    without replacement from n and of this sample variance, is off by more with
    probability at most ``failure``."""
    if k >= n:
        return 0.0
    rho = 1 - (k - 1) / n if k <= n / 2 else (1 - k / n) * (1 + 1 / k)
    log = math.log(5 / failure)
    return math.sqrt(2 * variance * rho * log / k) + (7 / 3 + 3 / math.sqrt(2)) * log / k


def betweenness(
    e: DataFrame,
    node_df: DataFrame,
    k: int | None = None,
    exact: bool = False,
    epsilon: float | None = None,
    failure: float = 0.1,
    seed: int = 42,
    chunk: int | None = None,
    normalized: bool = True,
) -> DataFrame:
    """Brandes betweenness, directed, shortest paths weighted by amount (as
    integer cents; zero amounts count as one cent), normalised by
    1 / ((n-1)(n-2)).

    The caller says from how many pivots: ``exact`` (every node), ``k`` of them
    (scaled by n / k; more than there are is an error), or ``epsilon``: pivots
    are drawn, chunk by chunk and at least doubling, until with probability
    1 - ``failure`` no node's value is off by more than ``epsilon``
    (``sampling_error``, shared out over nodes and looks), at the latest when
    all have been drawn.

    Pivots are a table with their rank in a seeded hash order; a chunk of them
    is a range of ranks (``_chunk_sums``). ``chunk`` pivots make one; if not given,
    ``PIVOTS_A_CHUNK``, and with a known number of pivots all of them where the edges
    are broadcast, else as many as ``ROWS_A_CHUNK`` allows (``_pivots_a_chunk``)."""
    if (k is not None) + exact + (epsilon is not None) != 1:
        raise ValueError("betweenness needs one of k, exact or epsilon")
    node_df = checkpointed(node_df.select("account"))  # counted, ranked and joined: worked out once
    n = node_df.count()
    if k is not None and not 0 < k <= n:
        raise ValueError(f"{k} pivots asked for, {n} nodes")
    if n <= 2:
        return node_df.select("account", F.lit(0.0).alias("betweenness"))
    ids = checkpointed(ranked_pivots(node_df, seed))  # the rank is the node's number as well
    cents = F.greatest(F.round(F.col("amount") * 100).cast("long"), F.lit(1))
    named = e.select("src", "dst", cents.alias("w")).where(F.col("src") != F.col("dst"))
    if k is not None:  # no path from a pivot passes a node that is neither a pivot nor receives
        pivots = ids.where(F.col("rank") < k).select(F.col("account").alias("src"))
        named = named.join(pivots.union(named.select("dst")).distinct(), "src", "left_semi")
    w = checkpointed(
        named.join(ids.select(F.col("account").alias("src"), F.col("rank").alias("u")), "src")
        .join(ids.select(F.col("account").alias("dst"), F.col("rank").alias("v")), "dst")
        .select("u", "v", "w")
    )
    last = n if k is None else k
    if chunk is None:
        chunk = PIVOTS_A_CHUNK if epsilon is not None else last if _few(_passed(w)) else _pivots_a_chunk(w)
    total, done, looks = None, 0, max(1, math.ceil(math.log2(max(n / chunk, 1))) + 1)
    look_at = chunk
    while done < last:
        upto = min(done + chunk, last)
        part = _chunk_sums(ids.where((F.col("rank") >= done) & (F.col("rank") < upto)).select("rank"), w)
        total = part if total is None else total.unionByName(part)
        total = checkpointed(total.groupBy("node").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")))
        done = upto
        if epsilon is not None and done >= look_at and done < n:
            look_at = 2 * done
            mean = F.col("s") / F.lit(done * (n - 2.0))
            spread = total.agg(F.max(F.col("ss") / F.lit(done * (n - 2.0) ** 2) - mean * mean)).first()[0] or 0.0
            variance = max(spread, 0.0) * done / max(done - 1, 1)
            if n / (n - 1) * sampling_error(variance, done, n, failure / (n * looks)) <= epsilon:
                break
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / done) if normalized else n / done
    found = ids.join(total.select(F.col("node").alias("rank"), "s"), "rank", "left")
    return found.select("account", (F.coalesce(F.col("s"), F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def _pivots_a_chunk(w: DataFrame) -> int:
    """Pivots whose rounds pass at most ``ROWS_A_CHUNK`` rows (``PIVOTS_A_CHUNK`` at least).
    A pivot reaches only nodes that receive, and passes, beside its own edges,
    only those that such nodes send: a chunk's rounds cost the same few
    jobs whatever it holds, so a sparse reach allows many pivots."""
    return max(PIVOTS_A_CHUNK, ROWS_A_CHUNK // max(_passed(w).count(), _receivers(w).count(), 1))


def _receivers(w: DataFrame) -> DataFrame:
    return w.select(F.col("v").alias("u")).distinct()


def _passed(w: DataFrame) -> DataFrame:
    """Edges of nodes that receive: a path passes only such behind its first one."""
    return w.join(_receivers(w), "u", "left_semi").select("u", "v", "w")


def _few(passed: DataFrame) -> bool:
    return passed.limit(CORE_EDGES + 1).count() <= CORE_EDGES


def _chunk_sums(pivots: DataFrame, w: DataFrame) -> DataFrame:
    """node, s, ss: sums of the dependencies of ``pivots`` on a node and of their
    squares; from a broadcast of the edges that paths pass where these are few,
    by (pivot, node) rows and shuffles where not."""
    passed = _passed(w)
    return _sums_of_blocks(pivots, w, passed) if _few(passed) else _sums_of_rows(pivots, w)


class _Core(NamedTuple):
    """Edges that paths pass behind their first one, by receiver: numbers of their
    ends within ``ids`` (the ranks, ascending) and weights."""

    ids: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray


def _core_of(passed: DataFrame) -> _Core:
    edges = passed.toArrow()
    u, v, w = (edges.column(c).to_numpy() for c in ("u", "v", "w"))
    order = np.argsort(v, kind="stable")
    ids, ends = np.unique(np.concatenate((u[order], v[order])), return_inverse=True)
    return _Core(ids, ends[: len(order)], ends[len(order) :], w[order])


def _runs(keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal ``keys``."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _dependencies(core: _Core, node: np.ndarray, column: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
    """Brandes' dependencies (nodes x ``width`` pivots). A pivot's paths begin at
    the nodes ``node``, in its ``column``, at the distances ``d``: behind its own
    edges, or at itself with 0. Rounds relax, count and sum along all edges, for all
    pivots side by side, until nothing changes; weights are positive, so each
    takes as many rounds as the longest shortest path has edges."""
    w, into, by_u = core.w[:, None], _runs(core.v), np.argsort(core.u, kind="stable")
    heads, out = core.v[into], _runs(core.u[by_u])
    tails = core.u[by_u][out]
    dist = np.full((len(core.ids), width), np.iinfo(np.int64).max // 4)
    np.minimum.at(dist, (node, column), d)
    while True:
        nearer = np.minimum(dist[heads], np.minimum.reduceat(dist[core.u] + w, into, axis=0))
        if np.array_equal(nearer, dist[heads]):
            break
        dist[heads] = nearer
    shortest = dist[core.u] + w == dist[core.v]
    begun = np.zeros(dist.shape)
    tight = dist[node, column] == d
    np.add.at(begun, (node[tight], column[tight]), 1.0)
    paths, before = begun, None
    while before is None or not np.array_equal(paths, before):
        before, paths = paths, begun.copy()
        paths[heads] += np.add.reduceat(np.where(shortest, before[core.u], 0.0), into, axis=0)
    share = np.divide(paths[core.u], paths[core.v], out=np.zeros(shortest.shape), where=shortest)
    delta, before = np.zeros(dist.shape), None
    while before is None or not np.array_equal(delta, before, equal_nan=True):
        before, delta = delta, np.zeros(dist.shape)
        delta[tails] = np.add.reduceat((share * (1.0 + before[core.v]))[by_u], out, axis=0)
    delta[dist == 0] = 0.0  # the pivots themselves
    return delta


def _sums_of_blocks(pivots: DataFrame, w: DataFrame, passed: DataFrame) -> DataFrame:
    """``_chunk_sums`` with the edges ``passed`` in a broadcast. Pivots are dealt over
    tasks with where their paths begin; a task adds up its pivots, block by block,
    and gives one row a node."""
    core = _core_of(passed)
    if not len(core.w):
        return pivots.limit(0).select(F.col("rank").alias("node"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
    receivers = _receivers(w).withColumnRenamed("u", "rank")
    own = pivots.join(receivers, "rank", "left_anti").join(w.withColumnRenamed("u", "rank"), "rank").select("rank", F.col("v").alias("node"), F.col("w").alias("d"))
    itself = pivots.join(receivers, "rank", "left_semi").select("rank", F.col("rank").alias("node"), F.lit(0).cast("long").alias("d"))
    context = pivots.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, -(-pivots.count() * len(core.w) // PAIRS_A_TASK))
    shared, width = context.broadcast(core), min(512, max(1, PAIRS_A_BLOCK // len(core.w)))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core = shared.value
        s, ss, held = np.zeros(len(core.ids)), np.zeros(len(core.ids)), None
        for frame in chain(frames, [None]):
            rows = held if frame is None else frame if held is None else pd.concat([held, frame])
            if rows is None or rows.empty:
                continue
            begin = np.append(_runs(rows["rank"].to_numpy()), len(rows))
            whole = len(begin) - 1 if frame is None else (len(begin) - 2) // width * width  # the last pivot may go on
            for i in range(0, whole, width):
                upto = min(i + width, whole)
                part = rows.iloc[begin[i] : begin[upto]]
                column = np.repeat(np.arange(upto - i), np.diff(begin[i : upto + 1]))
                node = np.minimum(np.searchsorted(core.ids, part["node"].to_numpy()), len(core.ids) - 1)
                met = core.ids[node] == part["node"].to_numpy()
                delta = _dependencies(core, node[met], column[met], part["d"].to_numpy()[met], upto - i)
                s, ss = s + delta.sum(axis=1), ss + (delta * delta).sum(axis=1)
            held = rows.iloc[begin[whole] :]
        on = s > 0
        yield pd.DataFrame({"node": core.ids[on], "s": s[on], "ss": ss[on]})

    begun = own.unionByName(itself).repartition(tasks, "rank").sortWithinPartitions("rank")
    found = begun.mapInPandas(sums, "node long, s double, ss double")
    return found.groupBy("node").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))


def _distances(pivots: DataFrame, w: DataFrame) -> DataFrame:
    """(pivot, node, d) of all reachable nodes: the nodes that came nearer in a
    round relax their edges in the next one."""
    start = pivots.select(F.col("rank").alias("pivot"), F.col("rank").alias("node"), F.lit(0).cast("long").alias("d"))
    best, frontier = start, start
    while True:
        reached = frontier.join(w, frontier["node"] == w["u"]).groupBy("pivot", F.col("v").alias("node")).agg(
            F.min(F.col("d") + F.col("w")).alias("d")
        )
        both = best.select("pivot", "node", "d", F.col("d").alias("old")).unionByName(
            reached.select("pivot", "node", "d", F.lit(None).cast("long").alias("old"))
        )
        state = checkpointed(both.groupBy("pivot", "node").agg(F.min("d").alias("d"), F.min("old").alias("old")))
        best = state.select("pivot", "node", "d")
        frontier = state.where(F.col("old").isNull() | (F.col("d") < F.col("old"))).select("pivot", "node", "d")
        if frontier.isEmpty():
            return best


def _path_counts(best: DataFrame, dag: DataFrame) -> list[DataFrame]:
    """(pivot, node, sigma, level) by level: a node is settled, with its number of
    shortest paths, once all its predecessors are, so each edge is passed once."""
    first = best.where(F.col("node") == F.col("pivot")).select("pivot", "node", F.lit(1.0).alias("sigma"), F.lit(0).alias("level"))
    levels = [first]
    need = dag.groupBy("pivot", F.col("v").alias("node")).agg(F.count("*").alias("left"), F.lit(0.0).alias("sigma"))
    waiting = need
    while True:
        sent = levels[-1].join(dag.withColumnRenamed("u", "node"), ["pivot", "node"]).groupBy(
            "pivot", F.col("v").alias("node")
        ).agg((-F.count("*")).alias("left"), F.sum("sigma").alias("sigma"))
        both = waiting.unionByName(sent).groupBy("pivot", "node").agg(F.sum("left").alias("left"), F.sum("sigma").alias("sigma"))
        state = checkpointed(both)
        settled = state.where("left = 0")
        if settled.isEmpty():
            return levels
        levels.append(settled.select("pivot", "node", "sigma", F.lit(len(levels)).alias("level")))
        waiting = state.where("left > 0")


def _sums_of_rows(pivots: DataFrame, w: DataFrame) -> DataFrame:
    """``_chunk_sums`` with (pivot, node) rows; each edge of a shortest-path graph is
    passed once per direction.

    1. distances by frontier relaxation; 2. the edges of shortest paths;
    3. path counts level by level; 4. dependencies backwards, level by level:
    the nodes of a level are complete when all levels behind it have sent."""
    best = _distances(pivots, w)
    dag = checkpointed(
        best.join(w, best["node"] == w["u"])
        .select("pivot", "u", "v", (F.col("d") + F.col("w")).alias("d"))
        .join(best.withColumnRenamed("node", "v"), ["pivot", "v", "d"])
        .select("pivot", "u", "v")
    )
    levels = _path_counts(best, dag)
    settled = reduce(DataFrame.unionByName, levels)
    near = settled.select("pivot", F.col("node").alias("u"), F.col("sigma").alias("su"), F.col("level").alias("lu"))
    far = settled.select("pivot", F.col("node").alias("v"), F.col("sigma").alias("sv"), F.col("level").alias("lv"))
    shares = checkpointed(
        dag.join(far, ["pivot", "v"]).join(near, ["pivot", "u"]).select(
            "pivot", "u", "v", (F.col("su") / F.col("sv")).alias("share"), "lu", "lv"
        )
    )
    open_ = shares.limit(0).select("pivot", F.col("u").alias("node"), F.col("lu").alias("level"), F.lit(0.0).alias("delta"))
    complete, results = open_, []
    for level in range(len(levels) - 1, 0, -1):
        behind = complete.select("pivot", F.col("node").alias("v"), "delta")
        sent = shares.where(F.col("lv") == level).join(behind, ["pivot", "v"], "left").select(
            "pivot", F.col("u").alias("node"), F.col("lu").alias("level"),
            (F.col("share") * (F.lit(1.0) + F.coalesce(F.col("delta"), F.lit(0.0)))).alias("delta"),
        )
        both = open_.unionByName(sent).groupBy("pivot", "node", "level").agg(F.sum("delta").alias("delta"))
        state = checkpointed(both)
        complete, open_ = state.where(F.col("level") == level - 1), state.where(F.col("level") < level - 1)
        if level > 1:  # at level 0 there are the pivots themselves
            results.append(complete.select("node", "delta"))
    found = reduce(DataFrame.unionByName, results) if results else complete.limit(0).select("node", "delta")
    return found.groupBy("node").agg(F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("ss"))
