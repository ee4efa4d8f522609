"""E: the account graph as two tables and its structural features.

* nodes: ``account`` (+ ``is_fraud``: the account ever *sent* a fraud row);
* edges: one row per (src, dst) pair; the latest transaction (by step, tx_id)
  supplies every attribute (a directed simple graph: repeats collapse).

All measures are joins and aggregations keyed by account; the feature table is
assembled by left joins on ``account`` and missing values become 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.distributed import checked_broadcast, checkpointed
from txrisk.sources.schema import ACCOUNT_AGGS, GRAPH_FEATURE_COLS, STEPS_PER_PERIOD

# --- fixed values: neighbour sampling fan-outs per hop ---
SAMPLE_FANOUTS = [15, 10, 5]
TEMPORAL_WINDOW = 24


def nodes(tx: DataFrame) -> DataFrame:
    """Distinct accounts appearing as origin or destination."""
    return (
        tx.select(F.col("nameOrig").alias("account"))
        .union(tx.select(F.col("nameDest").alias("account")))
        .where(F.col("account").isNotNull())
        .distinct()
    )


def edges(tx: DataFrame, collapse: str = "last") -> DataFrame:
    """One edge per (src, dst). ``last``: attributes of the latest row
    (``max_by`` over (step, tx_id), map-side combined); ``sum``: amounts added,
    other attributes from the latest row."""
    tx_type = F.col("type_encoded") if "type_encoded" in tx.columns else F.lit(0)
    attrs = F.struct(
        F.col("amount").cast("double").alias("amount"),
        F.log1p(F.col("amount")).alias("amount_log"),
        F.col("step").alias("step"),
        tx_type.alias("tx_type"),
        F.col("isFraud").alias("is_fraud"),
    )
    order = F.struct("step", "tx_id")
    g = tx.where(F.col("nameOrig").isNotNull() & F.col("nameDest").isNotNull()).groupBy(
        F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst")
    )
    if collapse == "last":
        e = g.agg(F.max_by(attrs, order).alias("a"))
        return e.select("src", "dst", "a.*")
    if collapse == "sum":
        e = g.agg(F.max_by(attrs, order).alias("a"), F.sum("amount").alias("total"))
        return e.select("src", "dst", F.col("total").alias("amount"), F.log1p("total").alias("amount_log"),
                        "a.step", "a.tx_type", "a.is_fraud")
    raise ValueError(f"unknown collapse mode: {collapse}")


def account_labels(tx: DataFrame, node_df: DataFrame | None = None) -> DataFrame:
    """is_fraud = 1 if the account sent at least one fraud row, for every node."""
    node_df = node_df if node_df is not None else nodes(tx)
    senders = tx.groupBy(F.col("nameOrig").alias("account")).agg(F.max("isFraud").alias("is_fraud"))
    return node_df.join(senders, "account", "left").select(
        "account", F.coalesce(F.col("is_fraud"), F.lit(0)).cast("int").alias("is_fraud")
    )


def degrees(e: DataFrame) -> DataFrame:
    """E4 + E5: in/out degree over distinct neighbours (a self-loop counts in
    both) and weighted in/out degree (sum of collapsed edge amounts)."""
    out_d = e.groupBy(F.col("src").alias("account")).agg(
        F.count(F.lit(1)).alias("out_degree"), F.sum("amount").alias("weighted_out_deg")
    )
    in_d = e.groupBy(F.col("dst").alias("account")).agg(
        F.count(F.lit(1)).alias("in_degree"), F.sum("amount").alias("weighted_in_deg")
    )
    j = out_d.join(in_d, "account", "full")
    return j.select(
        "account",
        F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
        F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
        (F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))).alias("degree"),
        F.coalesce("weighted_in_deg", F.lit(0.0)).alias("weighted_in_deg"),
        F.coalesce("weighted_out_deg", F.lit(0.0)).alias("weighted_out_deg"),
    )


def _undirected(e: DataFrame) -> DataFrame:
    """Distinct undirected pairs (a < b), self-loops dropped."""
    return (
        e.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )


def clustering(e: DataFrame) -> DataFrame:
    """Undirected local clustering = triangles / (deg (deg - 1) / 2), 0 if deg < 2.

    Triangles are listed once each by orienting every undirected edge from
    the lower to the higher (degree, account) rank and closing the wedges at
    each vertex's *oriented* out-neighbours (node-iterator with degree
    ordering): a vertex's oriented out-degree is at most sqrt(2m), so hubs
    produce few wedges and no vertex emits all pairs of its neighbours. Only
    edges between vertices that are reached can close a wedge: wedges are made
    of their ends alone, and are not shuffled where such edges are few."""
    und = _undirected(e)
    adj = und.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        und.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    deg = checkpointed(adj.groupBy("u").agg(F.count(F.lit(1)).alias("d")))
    ranked = (
        und.join(deg.select(F.col("u").alias("a"), F.col("d").alias("da")), "a")
        .join(deg.select(F.col("u").alias("b"), F.col("d").alias("db")), "b")
    )
    a_first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    oriented = checkpointed(
        ranked.select(
            F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("lo"),
            F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("hi"),
        )
    )
    reached = oriented.select(F.col("hi").alias("lo")).distinct()
    closing = checkpointed(oriented.join(reached, "lo", "left_semi").select(F.col("lo").alias("v"), F.col("hi").alias("w")))
    o1 = oriented.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(closing.select("v").distinct(), "v", "left_semi")
    o2 = oriented.select(F.col("lo").alias("u"), F.col("hi").alias("w")).join(closing.select("w").distinct(), "w", "left_semi")
    tri = o1.join(o2, "u").join(checked_broadcast(closing), ["v", "w"], "left_semi")
    per_node = tri.select(F.explode(F.array("u", "v", "w")).alias("u")).groupBy("u").agg(
        F.count(F.lit(1)).alias("t")
    )
    j = deg.join(per_node, "u", "left")
    cc = F.when(
        F.col("d") >= 2, F.lit(2.0) * F.coalesce(F.col("t"), F.lit(0)) / (F.col("d") * (F.col("d") - 1))
    ).otherwise(F.lit(0.0))
    return j.select(F.col("u").alias("account"), cc.alias("clustering_coeff"))


def avg_neighbor_degree(e: DataFrame, deg: DataFrame | None = None) -> DataFrame:
    """Mean out-degree of each node's successors (0 without successors)."""
    if deg is None:
        outd = e.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("_od"))
    else:
        outd = deg.select(F.col("account").alias("dst"), F.col("out_degree").alias("_od"))
    return e.select("src", "dst").join(outd, "dst", "left").groupBy(F.col("src").alias("account")).agg(
        F.avg(F.coalesce(F.col("_od"), F.lit(0)).cast("double")).alias("avg_neighbor_deg")
    )


def local_fraud_rate(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean label over predecessors ++ successors (UNION ALL: reciprocal
    neighbours and self-loops count twice); 0 without neighbours."""
    nb = e.select(F.col("src").alias("account"), F.col("dst").alias("nb")).unionAll(
        e.select(F.col("dst").alias("account"), F.col("src").alias("nb"))
    )
    lab = labels.select(F.col("account").alias("nb"), F.col("is_fraud").alias("_l"))
    return nb.join(lab, "nb", "left").groupBy("account").agg(
        F.avg(F.coalesce(F.col("_l"), F.lit(0)).cast("double")).alias("local_fraud_rate")
    )


#: Pivots of E7 where betweenness is one feature among many.
BETWEENNESS_PIVOTS = 500


def graph_features(
    tx: DataFrame,
    pagerank_iterations: int | None = None,
    betweenness_k: int | None = BETWEENNESS_PIVOTS,
    seed: int = 42,
) -> DataFrame:
    """One row per node with the 10 structural features and the label.

    ``pagerank_iterations``: fixed number of power iterations (None: iterate
    to the convergence test). ``betweenness_k``: pivots of E7, all nodes where
    there are fewer (None: exact, from every node)."""
    from txrisk.operators.centrality import betweenness, pagerank

    node_df = checkpointed(nodes(tx))
    e = edges(tx).persist()
    labels = account_labels(tx, node_df)
    deg = checkpointed(degrees(e))
    parts = [
        deg,
        pagerank(e, node_df, iterations=pagerank_iterations),
        clustering(e),
        avg_neighbor_degree(e, deg),
        local_fraud_rate(e, labels),
    ]
    k = None if betweenness_k is None else min(betweenness_k, node_df.count())
    parts.append(betweenness(e, node_df, k=k or None, exact=not k, seed=seed))
    j = reduce(lambda acc, p: acc.join(p, "account", "left"), parts, labels)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in GRAPH_FEATURE_COLS]
    return j.select("account", *cols, "is_fraud")


def account_aggregates(feat: DataFrame) -> DataFrame:
    """Per origin, means of the per-row columns and the per-account
    constants (``first`` in the reference; the values are constant per
    account, so ``max`` is the deterministic equivalent). Absent columns skip."""
    aggs = []
    for c, how in ACCOUNT_AGGS:
        if c not in feat.columns:
            continue
        aggs.append((F.avg(c) if how == "mean" else F.max(c)).cast("double").alias(c))
    return feat.groupBy(F.col("nameOrig").alias("account")).agg(*aggs)


def node_features(graph_feats: DataFrame, acct_aggs: DataFrame) -> DataFrame:
    """10 structural + 8 per-account columns per node (destination-only
    accounts get 0), NaN/null -> 0, plus the ``x`` vector (array<double>)."""
    tab_cols = [c for c, _ in ACCOUNT_AGGS if c in acct_aggs.columns]
    j = graph_feats.join(acct_aggs, "account", "left")
    filled = [
        F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
        for c in GRAPH_FEATURE_COLS + tab_cols
    ]
    out = j.select("account", "is_fraud", *filled)
    return out.withColumn("x", F.array(*[F.col(c) for c in GRAPH_FEATURE_COLS + tab_cols]))


def edge_attributes(e: DataFrame) -> DataFrame:
    """[amount_log, tx_type, step / 744, is_fraud] per edge."""
    return e.select(
        "src", "dst", "amount_log",
        F.col("tx_type").cast("double").alias("tx_type"),
        (F.col("step") / F.lit(float(STEPS_PER_PERIOD))).alias("step_norm"),
        F.col("is_fraud").cast("double").alias("is_fraud"),
    )


def temporal_subgraph(e: DataFrame, t: int, window: int = TEMPORAL_WINDOW) -> tuple[DataFrame, DataFrame]:
    """Edges with t - window <= step <= t (both ends) and their endpoints.
    Pass ``edges(tx.where(...))`` instead to keep older repeats of a pair."""
    sub = e.where(F.col("step").between(t - window, t))
    ends = sub.select(F.col("src").alias("account")).union(sub.select(F.col("dst").alias("account"))).distinct()
    return sub, ends


def sample_neighbors(
    e: DataFrame, seeds: DataFrame, fanouts: list[int] | None = None, seed: int = 42, salts: int = 16
) -> DataFrame:
    """Per hop, at most ``fanouts[h]`` in-neighbours (edge sources) of each
    frontier node, chosen by a seeded hash; the sampled nodes form the next
    frontier. Returns (seed_account, hop, node, nbr).

    Top-k per frontier node is exact and two-phase: top-k inside
    (seed, node, salt) buckets, then top-k over the <= salts * k survivors,
    so a hub's in-edges are spread over ``salts`` tasks."""
    fanouts = fanouts or SAMPLE_FANOUTS
    frontier = seeds.select(F.col("account").alias("seed_account"), F.col("account").alias("node")).distinct()
    inc = e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"))
    out = None
    for hop, k in enumerate(fanouts, start=1):
        key = F.concat_ws("|", F.col("seed_account"), F.col("node"), F.col("nbr"), F.lit(str(hop)), F.lit(str(seed)))
        cand = frontier.join(inc, "node").withColumn("_h", F.md5(key))
        cand = cand.withColumn("_salt", F.pmod(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long"), F.lit(salts)))
        w1 = Window.partitionBy("seed_account", "node", "_salt").orderBy("_h", "nbr")
        local = cand.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
        w2 = Window.partitionBy("seed_account", "node").orderBy("_h", "nbr")
        picked = local.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k).select(
            "seed_account", F.lit(hop).alias("hop"), "node", "nbr"
        )
        out = picked if out is None else out.unionByName(picked)
        frontier = picked.select("seed_account", F.col("nbr").alias("node")).distinct()
    return out


def join_node_scores(tx: DataFrame, scores: DataFrame, score_col: str = "gnn_proba") -> DataFrame:
    """Per-account score onto each transaction via its origin account
    (labels are sender-based); missing -> null (the blend then falls back)."""
    s = scores.select(F.col("account").alias("nameOrig"), F.col(score_col))
    return tx.join(s, "nameOrig", "left")
