"""Golden values, hand-made graphs against small pure-Python references,
invariants, and batch = stream equality."""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.functions import columns as X
from txrisk.functions.distributed import running_totals
from txrisk.operators import centrality as EC
from txrisk.operators import graph as E
from txrisk.operators import metrics as G
from txrisk.operators import prep as D
from txrisk.operators import resample as R
from txrisk.operators import scoring as H
from txrisk.sources.fixtures import tx_events
from txrisk.sources.schema import TX_SCHEMA

SF = "/root/testdata/sf0.001"


def _tx(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(tx_id=i, step=1, type="PAYMENT", amount=1.0, nameOrig="a", oldbalanceOrg=0.0, newbalanceOrig=0.0,
                 nameDest="b", oldbalanceDest=0.0, newbalanceDest=0.0, isFraud=0, isFlaggedFraud=0)
        d.update(r)
        full.append(tuple(d[f.name] for f in TX_SCHEMA.fields))
    return spark.createDataFrame(full, TX_SCHEMA)


FRAUD = dict(step=1, type="TRANSFER", amount=181374.0, nameOrig="C1231006815", oldbalanceOrg=181374.0,
             newbalanceOrig=0.0, nameDest="C553264065", oldbalanceDest=0.0, newbalanceDest=0.0)
LEGIT = dict(step=1, type="PAYMENT", amount=9839.64, nameOrig="C1231006815", oldbalanceOrg=170136.0,
             newbalanceOrig=160296.36, nameDest="M1979787155", oldbalanceDest=0.0, newbalanceDest=0.0)


def test_fraud_example_rules_and_features(spark):
    df = _tx(spark, [FRAUD])
    r = df.select(X.rule_score().alias("rule"), *X.row_features(), X.type_code().alias("code")).first()
    assert r["rule"] == pytest.approx(0.75)
    assert r["balance_diff_orig"] == -181374.0
    assert r["balance_ratio_orig"] == 0.0
    assert r["orig_balance_error"] == 0.0 and r["has_orig_error"] == 0
    assert r["dest_balance_error"] == 181374.0 and r["has_dest_error"] == 1
    assert r["is_round_amount"] == 0 and r["hour_of_day"] == 1 and r["code"] == 4
    reason = df.select(X.alert_reason(F.lit(0.5), X.rule_score())).first()[0]
    assert reason == ("High-risk tx type (TRANSFER); Origin account fully drained; "
                      "Destination balance unchanged (possible layering); Rule engine score: 0.75")


def test_legit_example(spark):
    df = _tx(spark, [LEGIT])
    r = df.select(X.rule_score().alias("rule"), X.alert_reason(F.lit(0.1), X.rule_score()).alias("why"),
                  *X.row_features(), X.type_code().alias("code")).first()
    assert r["rule"] == pytest.approx(0.25)
    assert r["why"] == "Destination balance unchanged (possible layering)"
    assert r["has_orig_error"] == 0 and r["code"] == 3


def test_reason_large_amount_and_confidence(spark):
    df = _tx(spark, [dict(type="CASH_OUT", amount=1234567.0, oldbalanceDest=1.0, newbalanceDest=2.0)])
    why = df.select(X.alert_reason(F.lit(0.8125), X.rule_score())).first()[0]
    assert why == "High-risk tx type (CASH_OUT); Very large amount ($1,234,567); ML model confidence: 81.25%"


def test_risk_cuts(spark):
    vals = [0.90, 0.8999, 0.70, 0.50, 0.4999]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(X.risk_level(F.col("p"))).collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_split_cuts(spark):
    df = _tx(spark, [dict(step=s) for s in (600, 601, 672, 673)])
    assert [r[0] for r in D.temporal_split(df).orderBy("tx_id").select("split").collect()] == ["train", "val", "val", "test"]


def test_temporal_window_both_ends(spark):
    df = _tx(spark, [dict(step=s, nameDest=f"d{s}") for s in (5, 6, 30, 31)])
    sub, _ = E.temporal_subgraph(E.edges(df), 30, 24)
    assert sorted(r["step"] for r in sub.collect()) == [6, 30]


def test_repeated_pair_last_wins(spark):
    df = _tx(spark, [dict(step=1, amount=10.0), dict(step=2, amount=7.0)])
    e = E.edges(df)
    assert [(r["amount"]) for r in e.collect()] == [7.0]
    d = {r["account"]: r for r in E.degrees(e).collect()}
    assert d["a"]["out_degree"] == 1 and d["a"]["weighted_out_deg"] == 7.0


def test_history_first_and_second_row(spark):
    df = _tx(spark, [dict(step=1, amount=5.0, nameDest="x"), dict(step=1, amount=3.0, nameDest="y")])
    got = {r["tx_id"]: r for r in H.history_features(df).collect()}
    assert (got[0]["orig_tx_count"], got[0]["orig_total_sent"], got[0]["orig_unique_dests"]) == (1, 5.0, 1)
    assert (got[1]["orig_tx_count"], got[1]["orig_total_sent"], got[1]["orig_unique_dests"]) == (2, 8.0, 1)


def _py_pagerank(nodes, edges, alpha=0.85, tol=1e-6, max_iter=100):
    n = len(nodes)
    out_w = {u: 0.0 for u in nodes}
    for u, v, w in edges:
        out_w[u] += w
    x = {u: 1.0 / n for u in nodes}
    for _ in range(max_iter):
        last = x
        dang = sum(last[u] for u in nodes if out_w[u] == 0)
        x = {u: 0.0 for u in nodes}
        for u, v, w in edges:
            if out_w[u]:
                x[v] += last[u] * w / out_w[u]
        x = {u: alpha * (x[u] + dang / n) + (1 - alpha) / n for u in nodes}
        if sum(abs(x[u] - last[u]) for u in nodes) < n * tol:
            return x
    raise RuntimeError


def _py_brandes(nodes, edges):
    adj = {u: [] for u in nodes}
    for u, v, w in edges:
        adj[u].append((v, w))
    bc = {u: 0.0 for u in nodes}
    for s in nodes:
        dist, sigma, preds, order = {s: 0}, {s: 1.0}, {s: []}, []
        heap = [(0, s)]
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in adj[u]:
                nd = d + w
                if v not in dist or nd < dist[v]:
                    dist[v], sigma[v], preds[v] = nd, sigma[u], [u]
                    heapq.heappush(heap, (nd, v))
                elif nd == dist[v] and v not in done:
                    sigma[v] += sigma[u]
                    preds[v].append(u)
        delta = {u: 0.0 for u in order}
        for v in reversed(order):
            for u in preds[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                bc[v] += delta[v]
    n = len(nodes)
    return {u: b / ((n - 1) * (n - 2)) for u, b in bc.items()}


GRAPH = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 2.0), ("a", "c", 2.0), ("d", "a", 1.0), ("b", "d", 3.0),
         ("e", "a", 1.0), ("c", "c", 1.0), ("d", "f", 1.0)]


def _graph_df(spark):
    e = spark.createDataFrame([(u, v, w) for u, v, w in GRAPH], "src string, dst string, amount double")
    nodes = sorted({u for u, _, _ in GRAPH} | {v for _, v, _ in GRAPH})
    nd = spark.createDataFrame([(u,) for u in nodes], "account string")
    return e, nd, nodes


def test_pagerank_matches_power_iteration(spark):
    e, nd, nodes = _graph_df(spark)
    got = {r[0]: r[1] for r in EC.pagerank(e, nd, scale_tol=True).collect()}
    exp = _py_pagerank(nodes, GRAPH)
    for u in nodes:
        assert got[u] == pytest.approx(exp[u], abs=1e-9)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-6)


def test_betweenness_matches_brandes(spark):
    e, nd, nodes = _graph_df(spark)
    got = {r[0]: r[1] for r in EC.betweenness(e, nd, exact=True).collect()}
    exp = _py_brandes(nodes, [(u, v, int(w * 100)) for u, v, w in GRAPH])
    for u in nodes:
        assert got[u] == pytest.approx(exp[u], abs=1e-12)


def _random_graph(spark, n=24, m=110, seed=6):
    rnd = random.Random(seed)
    links = {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}"): rnd.randint(1, 4) for _ in range(m)}
    e = spark.createDataFrame([(u, v, float(w)) for (u, v), w in links.items()], "src string, dst string, amount double")
    nodes = [f"n{i}" for i in range(n)]
    exact = _py_brandes(nodes, [(u, v, w * 100) for (u, v), w in links.items()])
    return e, spark.createDataFrame([(u,) for u in nodes], "account string"), exact


def test_betweenness_with_many_equal_paths_in_chunks(spark):
    e, nd, exp = _random_graph(spark)
    got = {r[0]: r[1] for r in EC.betweenness(e, nd, exact=True, chunk=13).collect()}
    assert got == pytest.approx(exp, abs=1e-12)


def test_betweenness_pivots_are_drawn_until_the_bound_holds(spark, monkeypatch):
    e, nd, exp = _random_graph(spark)
    drawn = []
    sums = EC._chunk_sums
    monkeypatch.setattr(EC, "_chunk_sums", lambda p, w: drawn.append(p.count()) or sums(p, w))
    monkeypatch.setattr(EC, "sampling_error", lambda var, k, n, f: 0.0 if k >= 10 else 1.0)
    got = {r[0]: r[1] for r in EC.betweenness(e, nd, epsilon=0.2, chunk=5).collect()}
    assert drawn == [5, 5]
    assert max(abs(got[u] - exp[u]) for u in exp) <= 0.2
    with pytest.raises(ValueError, match="one of k, exact or epsilon"):
        EC.betweenness(e, nd)


def test_sampling_error_covers_draws_without_replacement():
    rnd = np.random.default_rng(3)
    values = rnd.random(400) ** 6
    for k in (40, 150, 300):
        wrong = 0
        for _ in range(300):
            x = rnd.choice(values, k, replace=False)
            wrong += abs(x.mean() - values.mean()) > EC.sampling_error(x.var(ddof=1), k, 400, 0.1)
        assert wrong <= 30
    assert EC.sampling_error(0.2, 400, 400, 0.1) == 0.0
    assert EC.sampling_error(0.01, 300, 10**6, 1e-7) < EC.sampling_error(0.01, 100, 10**6, 1e-7)


def test_clustering_matches_brute_force(spark):
    e, _nd, nodes = _graph_df(spark)
    got = {r[0]: r[1] for r in E.clustering(e).collect()}
    und = {frozenset((u, v)) for u, v, _ in GRAPH if u != v}
    for u in got:
        nb = {next(iter(p - {u})) for p in und if u in p}
        k = len(nb)
        t = sum(1 for a in nb for b in nb if a < b and frozenset((a, b)) in und)
        assert got[u] == pytest.approx(2 * t / (k * (k - 1)) if k >= 2 else 0.0)
        assert 0.0 <= got[u] <= 1.0


def test_running_totals_multi_partition(spark):
    rnd = random.Random(3)
    vals = [(i, rnd.randint(0, 1), float(rnd.randint(0, 9))) for i in range(500)]
    df = spark.createDataFrame(vals, "k long, g int, v double")
    got = {r["k"]: r["cum_v"] for r in running_totals(df, [("k", True)], ["v"], ["g"], num_partitions=7).collect()}
    acc = {0: 0.0, 1: 0.0}
    for k, g, v in vals:
        acc[g] += v
        assert got[k] == acc[g]


def test_ranking_metrics_perfect_and_reversed(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, score double")
    r = G.ranking_metrics(df).first()
    assert r["auprc"] == pytest.approx(1.0) and r["auc_roc"] == pytest.approx(1.0)
    rev = df.select("label", (1 - F.col("score")).alias("score"))
    assert G.ranking_metrics(rev).first()["auc_roc"] == pytest.approx(0.0)
    none = df.select(F.lit(0).alias("label"), "score")
    assert G.ranking_metrics(none).first()["auprc"] is None


def test_exact_knn_matches_numpy(spark):
    rnd = np.random.default_rng(5)
    pts = rnd.normal(size=(120, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i long, x double, y double, z double")
    got = R.exact_knn(df, "i", ["x", "y", "z"], 4, block_rows=25).collect()
    nn = {}
    for r in got:
        nn.setdefault(r["i"], {})[r["_r"]] = r["_nb"]
    d = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        exp = list(np.lexsort((np.arange(len(pts)), d[i]))[:4])
        assert [nn[i][r] for r in range(4)] == exp


def test_approximate_neighbours_against_exhaustive_search(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(1500, 3)) @ rnd.normal(size=(3, 8)) + 0.05 * rnd.normal(size=(1500, 8))
    x[400:460] = x[7]  # equal rows do not make a leaf larger
    cols = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"{c} double" for c in cols))
    d = ((x[:, None, :] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, 1)[:, 4]
    found = R.approximate_knn(df, "i", cols, 5, leaf_rows=128).collect()
    assert len(found) == 1500 * 5 and len({(r["i"], r["_nb"]) for r in found}) == 1500 * 5
    assert np.mean([d[r["i"], r["_nb"]] <= kth[r["i"]] + 1e-9 for r in found]) >= 0.9
    one_leaf = R.approximate_knn(df, "i", cols, 5).collect()
    assert sorted(map(tuple, one_leaf)) == sorted(map(tuple, R.exact_knn(df, "i", cols, 5, block_rows=400).collect()))


def test_projection_trees_bound_their_leaves(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i), -1.0]) for i in range(2000)]
    base = spark.createDataFrame(rows, "_q long, _v array<double>")
    sizes = R._leaves(base, 2000, 3, 100, 2, 1).groupBy("_tree", "_leaf").count().collect()
    assert sum(r["count"] for r in sizes) == 3 * 2000 and max(r["count"] for r in sizes) <= 110


def test_smote_count_and_rows(spark):
    assert R.smote_count(10, 1000) == 90
    with pytest.raises(ValueError):
        R.smote_count(200, 1000)
    rows = [(i, 1 if i < 10 else 0, float(i % 7), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "tx_id long, isFraud int, a double, b double")
    out = R.smote(df, "isFraud", ["a", "b"], ratio=0.1)
    assert out.where("synthetic").count() == R.smote_count(10, 290)
    lo = df.where("isFraud = 1").agg(F.min("a"), F.max("a")).first()
    s = out.where("synthetic").agg(F.min("a"), F.max("a")).first()
    assert lo[0] <= s[0] and s[1] <= lo[1]


def test_stream_history_equals_batch(spark):
    from txrisk.streaming import stream as S
    from txrisk.streaming.runner import run_to_table

    tx = tx_events(spark, SF).select([f.name for f in TX_SCHEMA.fields])
    batch = {r[0]: tuple(r[1:]) for r in H.history_features(tx).collect()}
    streamed = run_to_table(spark, tx, lambda s: S.stream_history_features(s), chunks=4, timers=True)
    got = {r["tx_id"]: (r["orig_tx_count"], r["orig_total_sent"], r["orig_unique_dests"]) for r in streamed.collect()}
    assert len(got) == len(batch)
    for k, v in batch.items():
        assert got[k][0] == v[0] and got[k][2] == v[2] and math.isclose(got[k][1], v[1])


def test_stream_rule_alerts_equal_batch(spark):
    from txrisk.streaming import stream as S
    from txrisk.streaming.runner import run_to_table

    tx = tx_events(spark, SF)
    batch = H.score_batch(tx.withColumnRenamed("score_stub", "ml_proba"), "ml_proba")
    streamed = run_to_table(spark, tx, lambda s: S.stream_rule_alerts(s, "score_stub"), chunks=3)
    cols = ["tx_id", "fraud_proba", "is_fraud", "risk_level", "alert_reason"]
    assert sorted(map(tuple, batch.select(cols).collect())) == sorted(map(tuple, streamed.select(cols).collect()))


def test_results_stable_under_partitioning(spark):
    from txrisk.plans.catalog import QUERIES

    fn, _ = QUERIES["c16_engineer_features"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        a = sorted(map(tuple, fn(spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = sorted(map(tuple, fn(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_history_by_intervals_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [dict(step=rnd.randint(1, 120), nameOrig=f"o{rnd.randint(0, 2)}", nameDest=f"d{rnd.randint(0, 6)}",
                 amount=float(rnd.randint(1, 9))) for _ in range(400)]
    df = _tx(spark, rows)
    got = {r["tx_id"]: (r[1], r[2], r[3]) for r in H.history_features(df, 24).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        hist = [(j, q) for j, q in enumerate(rows) if q["nameOrig"] == r["nameOrig"] and (
            (r["step"] - 24 <= q["step"] < r["step"]) or (q["step"] == r["step"] and j < i))]
        n = len(hist)
        exp = (n + 1, sum(q["amount"] for _, q in hist) + r["amount"], len({q["nameDest"] for _, q in hist}) if n else 1)
        assert got[i] == exp, (i, got[i], exp)


def test_node_scores_are_trained_on_the_betweenness_of_e7(spark, monkeypatch):
    from txrisk.plans import catalog as Q

    feat = Q._feat(spark, "/root/testdata/sf0.001").where("tx_id % 12 = 0").persist()
    got = {r["account"]: r["betweenness"] for r in Q._node_features(feat).collect()}
    links = [(r["src"], r["dst"], max(round(r["amount"] * 100), 1)) for r in E.edges(feat).collect()]
    exp = _py_brandes(list(got), links)
    assert len(set(exp.values())) > 2
    assert got == pytest.approx(exp, abs=1e-9)


def test_distribution_query_has_every_feature(spark):
    from txrisk.operators.profile import DISTRIBUTION_FEATURES
    from txrisk.plans import catalog as Q

    rows = Q.QUERIES["b8_distribution_by_class_all"][0](spark, "/root/testdata/sf0.001").select("feature", "label").collect()
    assert {r["feature"] for r in rows} == set(DISTRIBUTION_FEATURES) and len(rows) == 2 * len(DISTRIBUTION_FEATURES)
