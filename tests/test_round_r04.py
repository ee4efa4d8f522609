"""Steps mended after round 4: betweenness from a broadcast of the edges that paths pass, stream state of many accounts,
trees from rows that are binned once."""

from __future__ import annotations

import random

import pytest

from tests.test_units import _py_brandes


def _layered(spark):
    """Senders that receive nothing, a chain with equal paths and a circle behind them, and ends that send nothing."""
    rnd = random.Random(5)
    links = {(f"s{i}", f"c{rnd.randrange(12)}"): rnd.randint(1, 3) for i in range(60) for _ in range(3)}
    links |= {(f"c{i}", f"c{(i + k) % 12}"): k for i in range(12) for k in (1, 2, 3)}
    links |= {(f"c{i}", f"e{i % 4}"): 1 for i in range(12)} | {("s0", "e0"): 2, ("s1", "lone"): 1}
    edges = spark.createDataFrame([(u, v, float(w)) for (u, v), w in links.items()], "src string, dst string, amount double")
    names = sorted({x for link in links for x in link})
    exact = _py_brandes(names, [(u, v, w * 100) for (u, v), w in links.items()])
    return edges, spark.createDataFrame([(x,) for x in names], "account string"), exact


def test_betweenness_of_few_passed_edges_writes_no_state_by_round(spark, monkeypatch):
    from txrisk.operators import centrality

    edges, nodes, exact = _layered(spark)
    written, write = [], centrality.checkpointed
    monkeypatch.setattr(centrality, "checkpointed", lambda df: written.append(df) or write(df))
    monkeypatch.setattr(centrality, "PAIRS_A_BLOCK", 150)  # blocks of three pivots
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # pivots lie across batches
    try:
        got = {r["account"]: r["betweenness"] for r in centrality.betweenness(edges, nodes, exact=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(exact, abs=1e-12) and max(got.values()) > 0
    assert len(written) <= 5  # nodes, ranks, numbered edges, sums; before: two a round and level


def test_betweenness_of_many_passed_edges_stays_with_rows(spark, monkeypatch):
    """Beyond the bound of the broadcast nothing is collected, and sums and their squares are the same."""
    from txrisk.operators import centrality

    edges, nodes, exact = _layered(spark)
    monkeypatch.setattr(centrality, "_core_of", lambda _passed: pytest.fail("collected"))
    monkeypatch.setattr(centrality, "CORE_EDGES", 47)  # there are 48
    got = {r["account"]: r["betweenness"] for r in centrality.betweenness(edges, nodes, exact=True).collect()}
    assert got == pytest.approx(exact, abs=1e-12)
    monkeypatch.undo()
    w = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (1, 2, 1), (0, 2, 2), (2, 0, 4), (3, 1, 1)], "u long, v long, w long")
    pivots = spark.range(4).withColumnRenamed("id", "rank")
    few, many = centrality._chunk_sums(pivots, w), centrality._sums_of_rows(pivots, w)
    for column in ("s", "ss"):
        one, other = ({r["node"]: r[column] for r in df.where("s > 0").collect()} for df in (few, many))
        assert one == pytest.approx(other) and sorted(one) == [0, 1, 2]


def test_history_of_a_bucket_is_that_of_each_of_its_accounts():
    """Rows of many accounts in one call, with late rows, nulls and endless amounts, as account by account."""
    import numpy as np
    import pandas as pd

    from txrisk.streaming import stream

    rng, state, alone = np.random.default_rng(4), None, {}
    for batch in range(6):
        n = 200
        rows = pd.DataFrame({
            "account": rng.integers(0, 9, n) if batch != 3 else 4, "step": rng.integers(20 * batch, 20 * batch + 40, n), "tx_id": np.arange(n),
            "nameDest": np.array([f"D{x}" if x else None for x in rng.integers(0, 5, n)], object), "amount": rng.integers(1, 10**6, n) / 100,
        }).sort_values(["account", "step", "tx_id"], ignore_index=True)
        rows.loc[rng.integers(0, n, 3), "amount"] = [np.nan, np.inf, np.nan]
        made, state = stream.history_of_accounts(rows["account"].to_numpy(), rows, state, 24)
        for a, part in rows.groupby("account"):
            one, alone[a] = stream.history_of_batch(part.reset_index(drop=True), alone.get(a), 24)
            pd.testing.assert_frame_equal(made.loc[part.index].reset_index(drop=True), one)
        for a, (steps, counts, sums, dests, dest_steps) in alone.items():
            mine, met = [i for i, x in enumerate(state[5]) if x == a], [i for i, x in enumerate(state[6]) if x == a]
            assert [state[0][i] for i in mine] == steps and [state[1][i] for i in mine] == counts
            assert [state[2][i] for i in mine] == pytest.approx(sums, nan_ok=True)
            assert sorted((state[3][i], state[4][i]) for i in met) == sorted(zip(dests, dest_steps))


class _State:
    """The handle of a bucket's state, as Spark hands it to the function."""

    hasTimedOut, exists, get, watermark, now = False, False, None, 0, 0

    def getCurrentWatermarkMs(self):
        return self.watermark

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.armed = ms


def test_a_bucket_drops_accounts_that_are_idle_and_past():
    import pandas as pd

    from txrisk.streaming import stream

    state, calls = _State(), []
    fn = stream._history_fn(24, ["tx_id"], 1000)

    def send(now, watermark_step, *rows):
        state.now, state.watermark = now, stream.EPOCH_SECONDS * 1000 + watermark_step * 3_600_000
        frame = pd.DataFrame(rows, columns=["tx_id", "nameOrig", "nameDest", "step", "amount"])
        calls.append([tuple(r) for out in fn((3,), iter([frame]), state) for r in out.itertuples(index=False)])
        return state.get[8]

    assert send(0, 0, (1, "a", "x", 10, 1.0), (2, "b", "x", 10, 2.0), (3, None, "y", 11, 4.0)) == ["a", "b", None]
    assert send(500, 90, (4, "a", "y", 12, 8.0)) == ["a", "b", None]  # past, but not idle
    assert send(1200, 34, (5, "a", "x", 34, 1.0)) == ["a", "b", None]  # idle, but not past
    assert send(1300, 90, (6, "c", "x", 35, 1.0)) == ["a", "c"]
    assert send(1400, 90, (7, "a", "x", 36, 1.0), (8, None, "y", 36, 1.0)) == ["a", "c", None]
    assert calls[1] == [(4, 2, 9.0, 1)] and calls[2] == [(5, 3, 10.0, 2)] and calls[4] == [(7, 3, 10.0, 2), (8, 1, 1.0, 1)]


def _tree_rows(spark, n=900):
    """Features of few values, so that MLlib's bins hold one value each as well."""
    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(7)
    x = rnd.integers(0, 40, (n, 3)) / 4
    y = (x[:, 0] + rnd.normal(scale=2.0, size=n) > 6) | (x[:, 1] * x[:, 2] > 70)
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(isFraud=y.astype(int), tx_id=range(n)))


def test_trees_of_binned_rows_are_those_of_mllib(spark, monkeypatch, tmp_path):
    """Without draws both give one tree a round: the same scores, importances and, after loading, scores again."""
    from pyspark.ml.classification import GBTClassificationModel

    from txrisk.operators import boosting
    from txrisk.operators import models as M

    df, cols, scores, weights = _tree_rows(spark), list("abc"), {}, {}
    for name, value in (("subsample", 1.0), ("colsample", 1.0), ("max_depth", 4)):
        monkeypatch.setitem(M.GBT_A, name, value)
    for bound in (10_000, 0):
        monkeypatch.setattr(boosting, "ROWS_BINNED", bound)
        if not bound:
            monkeypatch.setattr(boosting, "RandomForestRegressor", lambda **_k: pytest.fail("rows were binned anew"))
        model = M.train_gbt_a(df, cols=cols, rounds=3)
        scores[bound] = {r["tx_id"]: r["p"] for r in M.predict_proba(model, df, "p", cols).collect()}
        weights[bound] = model.featureImportances.toArray().tolist()
    assert scores[0] == pytest.approx(scores[10_000], abs=1e-9) and len(set(scores[0].values())) > 5
    assert weights[0] == pytest.approx(weights[10_000], abs=1e-9)
    model.save(str(tmp_path / "m"))
    again = M.predict_proba(GBTClassificationModel.load(str(tmp_path / "m")), df, "p", cols).collect()
    assert {r["tx_id"]: r["p"] for r in again} == scores[0]


def test_binned_rounds_stop_by_patience_and_keep_the_best(spark, monkeypatch):
    from txrisk.operators import boosting
    from txrisk.operators import models as M

    df, cols = _tree_rows(spark), list("abc")
    train, val = df.where("tx_id < 600"), df.where("tx_id >= 600")
    monkeypatch.setattr(boosting, "ROWS_BINNED", 0)
    monkeypatch.setattr(boosting, "MEASURED_AT_ONCE", 3)
    monkeypatch.setattr(boosting, "CUT_EVERY", 4)
    monkeypatch.setitem(M.GBT_B, "early_stop", 4)
    monkeypatch.setitem(M.GBT_B, "max_depth", 3)
    found = M.boost_gbt_b(train, val, cols=cols, rounds=40)
    best = max(range(len(found.precision)), key=lambda i: (found.precision[i], -i)) + 1
    assert found.best == best and found.rounds == len(found.precision) == best + 4
    # the margins that were measured are those of the finished model
    assert M.round_auprc(found.model, val, "isFraud", cols) == pytest.approx(found.precision[:best], abs=2e-3)
    again = M.boost_gbt_b(train, val, cols=cols, rounds=40)
    assert again.precision == found.precision
    assert M.boost_gbt_b(train, val, cols=cols, rounds=2).rounds == 2


def test_bounds_of_bins_lie_between_values():
    import numpy as np

    from txrisk.operators.binned_trees import bounds_of

    assert bounds_of(np.array([3.0, 1.0, 1.0, 2.0]), 64).tolist() == [1.5, 2.5]
    assert bounds_of(np.zeros(5), 64).tolist() == []
    many = bounds_of(np.arange(10_000.0), 64)
    assert len(many) == 63 and max(np.diff(np.concatenate(([0], many, [10_000])))) < 200
