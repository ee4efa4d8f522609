"""Steps mended after round 3: boosting's tasks, betweenness' chunks, written graph frames, feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.operators import boosting


def test_boosting_deals_rows_over_all_cores(spark, monkeypatch):
    """Rows that come in two partitions are worked on by every core; few rows stay in one task."""
    monkeypatch.setattr(boosting, "ROWS_A_TASK", 100)
    rows = spark.range(1000).select(F.col("id").alias("features")).coalesce(2)
    cores = spark.sparkContext.defaultParallelism
    margins = boosting._Margins(rows, 0.1, 1)
    try:
        assert margins.n == margins.rows.count() == 1000
        assert margins.rows.rdd.getNumPartitions() >= cores
        assert margins.rows.rdd.getNumPartitions() % cores == 0
    finally:
        margins.close()
    few = boosting._Margins(rows.where("features < 100"), 0.1, 1)
    try:
        assert few.rows.rdd.getNumPartitions() == 1
    finally:
        few.close()
    assert boosting.tasks_for(100 * cores + 1, cores) == 2 * cores


def test_betweenness_takes_all_pivots_at_once_where_few_rows_are_passed(spark, monkeypatch):
    """A sparse reach needs one chunk for more than 500 pivots; with a small bound on rows there are several."""
    from txrisk.operators import centrality

    edges = spark.range(600).select(
        F.concat(F.lit("S"), F.col("id")).alias("src"), F.concat(F.lit("T"), F.col("id") % 3).alias("dst"), F.lit(1.0).alias("amount")
    )
    nodes = edges.select(F.col("src").alias("account")).union(edges.select("dst")).distinct()
    chunks, sums = [], centrality._chunk_sums

    def counted(pivots, w):
        chunks.append(pivots.count())
        return sums(pivots, w)

    monkeypatch.setattr(centrality, "_chunk_sums", counted)
    got = centrality.betweenness(edges, nodes, exact=True).collect()
    assert chunks == [603] and len(got) == 603 and not any(r["betweenness"] for r in got)
    w = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (5, 6, 1)], "u long, v long, w long")
    monkeypatch.setattr(centrality, "PIVOTS_A_CHUNK", 2)
    monkeypatch.setattr(centrality, "ROWS_A_CHUNK", 30)
    assert centrality._pivots_a_chunk(w) == 10  # three nodes receive
    monkeypatch.setattr(centrality, "ROWS_A_CHUNK", 3)
    assert centrality._pivots_a_chunk(w) == 2


def test_history_of_a_batch_builds_no_frames_by_account():
    """Rows, late rows, nulls and state of one account against a plain count; no grouping by pandas in between."""
    import numpy as np
    import pandas as pd

    from txrisk.streaming import stream

    def refuse(*_a, **_k):
        raise AssertionError("a frame is grouped for each account")

    rng, state, held = np.random.default_rng(3), None, []
    for batch in range(5):
        steps = np.sort(rng.integers(20 * batch, 20 * batch + 30, 12))
        dests = np.array([f"D{x}" if x else None for x in rng.integers(0, 4, 12)], object)
        rows = pd.DataFrame({"step": steps, "tx_id": np.arange(12), "nameDest": dests, "amount": rng.integers(1, 9, 12) * 50.0})
        top = max((s for s, _d, _a in held), default=0)
        groupby, pd.DataFrame.groupby = pd.DataFrame.groupby, refuse
        try:
            made, state = stream.history_of_batch(rows, state, 24)
        finally:
            pd.DataFrame.groupby = groupby
        known = [h for h in held if h[0] >= top - 24]
        for (step, dest, amount), got in zip(rows[["step", "nameDest", "amount"]].itertuples(index=False), made.itertuples(index=False)):
            window = [h for h in known if h[0] >= step - 24]
            distinct = len({d for _s, d, _a in window if d is not None}) if window else 1
            assert tuple(got) == (len(window) + 1, sum(a for _s, _d, a in window) + amount, distinct)
            known.append((step, dest, amount))
            held.append((step, dest, amount))


def test_feature_rows_are_not_dealt_by_type(spark):
    """Where the size of the statistics is not known to be small, rows still are not shuffled by their few types."""
    from txrisk.operators.features import engineer_features
    from txrisk.sources.fixtures import tx_events

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = engineer_features(tx_events(spark, "/root/testdata/sf0.001"))
        plan = made._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_type = [line for line in plan.splitlines() if "Join [type#" in line]
    assert len(by_type) == 1 and "BroadcastHashJoin" in by_type[0]


def test_pagerank_rounds_send_only_from_nodes_that_receive(spark, monkeypatch):
    """Nodes without incoming edges have one value; only edges of the others are joined in a round."""
    from txrisk.operators import centrality

    rows = [(f"S{i}", f"T{i % 3}", 1.0 + i) for i in range(20)] + [("T0", "T1", 2.0), ("T1", "T0", 1.0), ("T1", "T2", 4.0), ("Z", "T0", 0.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, amount double")
    nodes = edges.select(F.col("src").alias("account")).union(edges.select("dst")).distinct()
    written, write = [], centrality.checkpointed

    def counted(df):
        out = write(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(centrality, "checkpointed", counted)
    got = {r["account"]: r["pagerank"] for r in centrality.pagerank(edges, nodes, iterations=7).collect()}
    assert min(n for columns, n in written if "w" in columns) == 3
    names, out = [r["account"] for r in nodes.collect()], {}
    for s, _d, a in rows:
        out[s] = out.get(s, 0.0) + a
    x = {v: 1 / len(names) for v in names}
    for _ in range(7):
        base = (0.85 * sum(x[v] for v in names if not out.get(v)) + 0.15) / len(names)
        y = {v: base for v in names}
        for s, d, a in rows:
            if out[s]:
                y[d] += 0.85 * x[s] * a / out[s]
        x = y
    assert set(got) == set(names) and all(abs(got[v] - x[v]) < 1e-12 for v in names)


def test_betweenness_from_pivots_numbers_only_edges_they_can_reach(spark, monkeypatch):
    from txrisk.operators import centrality

    rows = [(f"S{i}", "A", 1.0) for i in range(50)] + [("A", "B", 1.0), ("B", "C", 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, amount double")
    nodes = edges.select(F.col("src").alias("account")).union(edges.select("dst")).distinct()
    passed, sums = [], centrality._chunk_sums

    def counted(pivots, w):
        passed.append(w.count())
        return sums(pivots, w)

    monkeypatch.setattr(centrality, "_chunk_sums", counted)
    some = {r["account"]: r["betweenness"] for r in centrality.betweenness(edges, nodes, k=2, chunk=2).collect()}
    assert passed[0] <= 4 and len(some) == 53
    ranks = {r["account"]: r["rank"] for r in centrality.ranked_pivots(nodes).collect()}
    drawn = [a for a, r in ranks.items() if r < 2]
    before = {"A": 2 * sum(a[0] == "S" for a in drawn), "B": sum(a[0] == "S" or a == "A" for a in drawn)}
    for name, value in some.items():
        assert abs(value - before.get(name, 0) / (52 * 51) * 53 / 2) < 1e-12


def test_triangles_need_no_shuffle_of_wedges(spark):
    """Wedges end only in edges between reached vertices; values against a plain count."""
    from itertools import combinations

    from txrisk.operators.graph import clustering

    pairs = {(a, b) for a in range(30) for b in range(30) if a < b and (a * 7 + b * 3) % 4 == 0}
    edges = spark.createDataFrame([(f"N{a}", f"N{b}") for a, b in pairs] + [("N3", "N3"), ("X", "N1")], "src string, dst string")
    found = clustering(edges)
    got = {r["account"]: r["clustering_coeff"] for r in found.collect()}
    near = {}
    for a, b in [(f"N{a}", f"N{b}") for a, b in pairs] + [("X", "N1")]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for v, ns in near.items():
        closed = sum(b in near[a] for a, b in combinations(ns, 2))
        assert abs(got[v] - (2 * closed / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0.0)) < 1e-12
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert any("BroadcastHashJoin [v#" in line and "LeftSemi" in line for line in plan.splitlines())


def test_nearest_in_leaf_keeps_order_and_ties():
    """The k nearest by (distance, index), equal distances included, without sorting whole rows."""
    import numpy as np

    from txrisk.operators.resample import _nearest_in

    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 2)).astype(float)
    x[7] = np.nan
    i = rng.permutation(60)
    lexsort, sorted_rows = np.lexsort, []
    np.lexsort = lambda keys, **a: (sorted_rows.append(np.size(keys[0])), lexsort(keys, **a))[1]
    try:
        got = _nearest_in(x[:50], i[:50], x, i, 4)
    finally:
        np.lexsort = lexsort
    want = []
    for q in range(50):
        d = np.maximum((x[q] * x[q]).sum() + (x * x).sum(1) - 2.0 * x[q] @ x.T, 0.0)
        near = sorted((d[p], i[p]) for p in range(60) if p != q and np.isfinite(d[p]))[:4]
        want += [(i[q], b, a) for a, b in near]
    assert [tuple(r) for r in got[["_q", "_nb", "_d"]].itertuples(index=False)] == want
    assert max(sorted_rows) < 50 * 60


def test_rows_of_a_projection_forest_are_written_once(spark, monkeypatch):
    """A level writes its medians, one row a node, not all rows of all trees; the neighbours hold."""
    import numpy as np

    from txrisk.operators import resample

    written, write = [], resample.checkpointed

    def counted(df):
        out = write(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(resample, "checkpointed", counted)
    x = np.random.default_rng(2).normal(size=(300, 3))
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    got = resample.approximate_knn(points, "i", ["a", "b", "c"], 4, leaf_rows=64).collect()
    assert sum("_p" in columns for columns, _n in written) == 1
    assert [n for columns, n in written if "_m" in columns] == [6, 12, 24]
    true = {(i, j) for i in range(300) for j in np.argsort(((x[i] - x) ** 2).sum(1))[1:5]}
    found = {(r["i"], r["_nb"]) for r in got}
    assert len(got) == len(found) == 1200 and len(found & true) > 1080


def test_model_frames_work_out_features_once(spark):
    """The pass of the scaler fills the cache that the frames read."""
    from txrisk.plans import catalog

    spark.catalog.clearCache()
    frames = catalog._model_frames(spark, "/root/testdata/sf0.001")
    try:
        held = spark.sparkContext._jsc.sc().getRDDStorageInfo()
        assert any(info.numCachedPartitions() for info in held)
        assert "InMemory" in frames[0]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.catalog.clearCache()


def test_saved_graph_models_read_a_written_graph(spark, monkeypatch):
    """Every round of every method reads edges from buckets; a method's scores are written as they are made."""
    from txrisk.plans import catalog
    from txrisk.sources.graph_store import GraphStore

    kinds, held = [], []

    class Model:
        def __init__(self, **_k):
            pass

        def on_edges(self, e):
            kinds.append(type(e))
            return self

        def fit(self, _nodes):
            return self

        def write(self):
            return self

        def save(self, _path):
            pass

        def transform(self, nodes):
            return nodes.select("account", F.lit(0.5).alias("gnn_proba"))

        @classmethod
        def load(cls, _path):
            return cls()

    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "account string, is_fraud int")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    monkeypatch.setattr(catalog, "_degree_nodes", lambda _rows: (nodes, edges))
    monkeypatch.setattr(catalog.EN, "NodeClassifier", Model)
    monkeypatch.setattr(catalog.EN, "NodeClassifierModel", Model)
    monkeypatch.setattr(catalog, "checkpointed", lambda df: held.append(df) or df)
    got = catalog.e20_save_load_by_method(spark, "/root/testdata/sf0.001").collect()
    assert set(kinds) == {GraphStore} and len(kinds) == 9 and len(held) == 3 and len(got) == 6


def test_ensemble_scores_are_written_before_they_are_measured(spark, monkeypatch):
    """The measures of F9 read written scores, not the models' plans again and again."""
    from txrisk.plans import catalog

    class Scorer:
        def score(self, rows, gnn):
            return rows.withColumn("ml_proba", F.col(gnn))

    nodes = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "account string, gnn_proba double")
    rows = spark.createDataFrame([(1, 1, "test", "a"), (2, 0, "test", "b")], "tx_id long, isFraud int, split string, nameOrig string")
    measured = []
    monkeypatch.setattr(catalog, "_node_scores", lambda *_a: nodes)
    monkeypatch.setattr(catalog, "_noisy_frames", lambda *_a: (rows, rows, rows))
    monkeypatch.setattr(catalog.M, "fit_ensemble", lambda *_a, **_k: Scorer())
    monkeypatch.setattr(catalog.G, "evaluate", lambda df, *_a: measured.append(df) or df)
    got = catalog.f9_fit_ensemble(spark, "").collect()
    assert sorted(map(tuple, got)) == [(0, 0.1), (1, 0.9)]
    assert "Join" not in measured[0]._jdf.queryExecution().logical().toString()


def _labelled(spark, n):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(n).select("id", F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("isFraud", ((F.col("a") > 60) & (F.col("b") < 5) | (F.col("id") % 23 == 0)).cast("int"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)


def test_both_tree_models_share_their_rows(spark, monkeypatch):
    """Rows are cached once for both models, a round of many rows caches nothing, and the models are those fitted alone."""
    from pyspark.ml.regression import RandomForestRegressor

    from txrisk.operators import models as M

    rows, cached = _labelled(spark, 600), []

    class Fitter(RandomForestRegressor):
        def fit(self, targets):
            cached.append((targets.storageLevel.useMemory, spark.sparkContext._jsc.sc().getPersistentRDDs().size()))
            return super().fit(targets)

    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    monkeypatch.setattr(boosting, "RandomForestRegressor", Fitter)
    monkeypatch.setattr(M, "ROWS_SIDE_BY_SIDE", 0)
    monkeypatch.setattr(boosting, "ROWS_CACHED_A_ROUND", 0)
    both = M.boost_both(rows, cols=["a", "b"], rounds=3)
    assert len(cached) == 6 and not any(held for held, _n in cached)
    assert len({n for _held, n in cached}) == 1 and cached[0][1] <= before + 3  # rows, and two of the class counts
    monkeypatch.setattr(boosting, "ROWS_CACHED_A_ROUND", 600)
    alone = [fit(rows, cols=["a", "b"], rounds=3) for fit in (M.boost_gbt_a, M.boost_gbt_b)]
    for one, other in zip(both, alone):
        trees = [[t.toDebugString.split("\n", 1)[1] for t in m.model.trees] for m in (one, other)]
        assert len(trees[0]) == 3 and trees[0] == trees[1]


def test_tree_models_of_many_rows_run_one_after_the_other(spark, monkeypatch):
    """Beyond a bound MLlib holds the binned rows of one model's tree at a time."""
    import threading
    import time

    from txrisk.operators import models as M

    running, most, lock = [0], [0], threading.Lock()

    def fit(*_a):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        with lock:
            running[0] -= 1

    monkeypatch.setattr(M, "_fit", fit)
    rows = _labelled(spark, 50)
    M.boost_both(rows, cols=["a", "b"])
    assert most == [2]
    most[0] = 0
    monkeypatch.setattr(M, "ROWS_SIDE_BY_SIDE", 49)
    M.boost_both(rows, cols=["a", "b"])
    assert most == [1]
