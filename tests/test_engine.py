"""Value-based running totals, scan by name, stream state and models."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.functions.distributed import group_quantiles, running_totals
from txrisk.operators import boosting
from txrisk.operators import models as M
from txrisk.operators import scoring as H
from txrisk.sources import io as A
from txrisk.sources.fixtures import tx_events
from txrisk.sources.schema import TX_COLUMNS
from txrisk.streaming import stream as S
from txrisk.streaming.runner import run_to_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_totals_do_not_depend_on_reuse_or_aqe(spark, reuse, adaptive):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, 0.5, rnd.random()]), float(rnd.randint(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, s double, v double").repartition(7)
    old = {c: spark.conf.get(c) for c in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {r["k"]: r["cum_v"] for r in running_totals(df, [("s", False), ("k", True)], ["v"], ["g"]).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    total = {"a": 0.0, "b": 0.0}
    for k, g, _s, v in sorted(rows, key=lambda r: (-math.inf if r[2] is None else r[2], -r[0]), reverse=True):
        total[g] += v
        assert got[k] == total[g]


def test_group_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rnd.integers(0, 3, 500), "v": rnd.normal(size=500), "i": range(500)})
    got = group_quantiles(spark.createDataFrame(pdf), "v", "i", [0.25, 0.5, 0.9], ["g"], ["a", "b", "c"]).collect()
    for r in got:
        exp = np.quantile(pdf[pdf.g == r["g"]].v, [0.25, 0.5, 0.9])
        assert np.allclose([r["a"], r["b"], r["c"]], exp)


def test_scan_takes_csv_columns_by_name(spark, tmp_path):
    tx = tx_events(spark, SF).select(*TX_COLUMNS)
    swapped = [{"nameOrig": "nameDest", "nameDest": "nameOrig"}.get(c, c) for c in TX_COLUMNS]
    tx.select(*swapped).write.option("header", True).csv(str(tmp_path / "swapped.csv"))
    back = A.scan_transactions(spark, str(tmp_path / "swapped.csv")).select(*TX_COLUMNS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tx.collect()))
    tx.drop("isFlaggedFraud").write.option("header", True).csv(str(tmp_path / "short.csv"))
    with pytest.raises(ValueError, match=r"Missing columns: \['isFlaggedFraud'\]"):
        A.scan_transactions(spark, str(tmp_path / "short.csv"))


def _plain_history(rows, window):
    out = []
    for i, (step, dest, amount) in enumerate(rows):
        past = [r for r in rows[:i] if r[0] >= step - window]
        out.append((len(past) + 1, sum(r[2] for r in past) + amount, len({r[1] for r in past if r[1]}) if past else 1))
    return out


def test_stream_state_matches_plain_history_over_batches():
    rnd = random.Random(5)
    rows = sorted(((rnd.randint(0, 120), rnd.choice(["a", "b", "c", None]), float(rnd.randint(1, 9))) for _ in range(400)), key=lambda r: r[0])
    got, state, at = [], None, 0
    while at < len(rows):
        n = rnd.randint(1, 60)
        part = pd.DataFrame(rows[at : at + n], columns=["step", "nameDest", "amount"])
        made, state = S.history_of_batch(part, state, 24)
        got += [tuple(r) for r in made.itertuples(index=False)]
        at += n
        assert min(state[0]) >= max(state[0]) - 24  # evicted
        assert len(state[3]) <= 3
    assert got == _plain_history(rows, 24)


def test_stream_state_scores_a_late_row_by_its_own_window():
    first = pd.DataFrame([(10, "a", 1.0), (40, "b", 2.0)], columns=["step", "nameDest", "amount"])
    _, state = S.history_of_batch(first, None, 24)
    late = pd.DataFrame([(30, "c", 5.0)], columns=["step", "nameDest", "amount"])
    made, after = S.history_of_batch(late, state, 24)
    # step 10 was evicted at 40; the row of step 40 is in the state and counts
    assert tuple(made.iloc[0]) == (2, 7.0, 1)
    assert after[0] == [30, 40]


def test_a_late_row_does_not_bring_its_destination_back_in_time():
    first = pd.DataFrame([(40, "a", 1.0)], columns=["step", "nameDest", "amount"])
    _, state = S.history_of_batch(first, None, 24)
    rows = pd.DataFrame([(30, "a", 2.0), (60, "b", 4.0)], columns=["step", "nameDest", "amount"])
    made, _ = S.history_of_batch(rows, state, 24)
    # "a" was last met at 40, within the window of step 60, whatever came late
    assert made["orig_unique_dests"].tolist() == [1, 1] and made["orig_tx_count"].tolist() == [2, 2]


class _Clock:
    """The state handle of one account, as Spark hands it to the function."""

    def __init__(self, value, watermark_ms):
        self.get, self.watermark_ms, self.hasTimedOut, self.exists = value, watermark_ms, True, True
        self.removed, self.armed = False, None

    def getCurrentWatermarkMs(self):
        return self.watermark_ms

    def remove(self):
        self.removed = True

    def setTimeoutDuration(self, ms):
        self.armed = ms


def test_an_idle_account_is_dropped_only_when_event_time_has_passed_its_window():
    fn, hour = S._history_fn(24, ["tx_id"], 1000), 3_600_000
    for watermark, gone in ((100 * hour, False), (124 * hour, False), (124 * hour + 1, True)):
        state = _Clock(([100], [1], [1.0], [], [], 100 * hour), watermark)
        assert list(fn(("x",), iter([]), state)) == []
        assert (state.removed, state.armed) == (gone, None if gone else 1000)


def test_stream_state_is_linear_for_a_busy_account():
    def seconds(n):
        part = pd.DataFrame({"step": np.arange(n) // 1000, "nameDest": [f"d{i % 997}" for i in range(n)], "amount": 1.0})
        began = time.process_time()
        S.history_of_batch(part, None, 24)
        return time.process_time() - began

    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(10_000), 0.01)


def _noisy(spark, n=1500):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(n, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] + rnd.normal(scale=1.2, size=n) > 1.6).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(isFraud=y, tx_id=range(n))
    df = spark.createDataFrame(pdf)
    return df.where("tx_id < 1000"), df.where("tx_id >= 1000"), float(y[1000:].mean())


def test_boosting_stops_by_patience_and_keeps_the_best_round(spark, monkeypatch):
    train, val, prevalence = _noisy(spark)
    cols = list("abcd")
    monkeypatch.setitem(M.GBT_A, "early_stop", 4)
    monkeypatch.setitem(M.GBT_A, "max_depth", 3)
    monkeypatch.setattr(boosting, "CUT_EVERY", 3)
    found = M.boost_gbt_a(train, val, cols=cols, rounds=40)
    best = max(range(len(found.precision)), key=lambda i: (found.precision[i], -i)) + 1
    assert found.model.getNumTrees == best and found.rounds == len(found.precision) == best + 4
    assert prevalence + 0.1 < found.precision[best - 1] < 1.0
    # margins kept from round to round give what the finished model gives (sums in another order may split ties)
    assert M.round_auprc(found.model, val, "isFraud", cols) == pytest.approx(found.precision[:best], abs=2e-3)
    from txrisk.operators.metrics import average_precision

    scored = M.predict_proba(found.model, val, "score", cols).withColumnRenamed("isFraud", "label")
    assert average_precision(scored).first()[0] == pytest.approx(found.precision[best - 1], abs=2e-3)
    assert found.model.featureImportances.size == 4


def test_a_boosted_tree_holds_the_bounded_newton_step(spark, monkeypatch):
    rows = [(float(x), int(x > 2 or x == 0)) for x in range(6) for _ in range(10)]
    df = spark.createDataFrame(rows, "a double, isFraud int")
    monkeypatch.setitem(M.GBT_B, "subsample", 1.0)
    monkeypatch.setitem(M.GBT_B, "colsample", 1.0)
    p = M.predict_proba(M.boost_gbt_b(df, None, cols=["a"], rounds=1).model, df, "p", ["a"]).select("isFraud", "p").distinct().collect()
    assert sorted((r["isFraud"], round(r["p"], 9)) for r in p) == [
        (y, round(1 / (1 + math.exp(-0.05 * step)), 9)) for y, step in ((0, -2.0), (1, 2.0))
    ]


def test_average_precision_by_ranges_of_scores(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(round(rnd.random(), 2), rnd.choice([True, False, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "s double, hit boolean")
    order = sorted({s for s, _ in rows}, reverse=True)
    area = seen = hits = 0
    for s in order:
        new = sum(1 for x, h in rows if x == s and h)
        seen, hits = seen + sum(x == s for x, _ in rows), hits + new
        area += new * hits / seen
    assert boosting.average_precision_of(df, "s", "hit") == pytest.approx(area / hits)
    monkeypatch.setattr(boosting, "ROWS_A_RANGE", 120)
    assert boosting.average_precision_of(df, "s", "hit") == pytest.approx(area / hits)
    assert boosting.average_precision_of(df.where("hit is null"), "s", "hit") == 0.0


def test_ensemble_round_trip_and_null_graph_score(spark, tmp_path):
    train, val, _ = _noisy(spark)
    cols = list("abcd")
    a = M.train_gbt_a(train, cols=cols, rounds=3)
    b = M.train_gbt_b(train, cols=cols, rounds=3)
    scores = M.predict_proba(b, M.predict_proba(a, train, "p_xgb", cols), "p_lgb", cols).withColumn("p_gnn", F.col("p_xgb"))
    ens = M.Ensemble(a, b, M.fit_stacker(scores), 0.4, cols)
    rows = val.withColumn("g", F.when(F.col("tx_id") % 3 == 0, F.lit(None)).otherwise(F.lit(0.3)))
    before = {r["tx_id"]: r["ml_proba"] for r in ens.score(rows, gnn="g").collect()}
    two = {r["tx_id"]: r["ml_proba"] for r in M.Ensemble(a, b, None, 0.4, cols).score(rows).collect()}
    assert all(before[i] == pytest.approx(two[i]) for i in before if i % 3 == 0)
    from txrisk.operators import prep as D

    ens.scaler = D.fit_scaler(train, cols)
    ens.save(str(tmp_path / "e"))
    again = M.Ensemble.load(spark, str(tmp_path / "e"))
    assert again.threshold == 0.4 and again.cols == cols and again.stacker is not None
    after = {r["tx_id"]: r["ml_proba"] for r in again.score(rows, gnn="g").collect()}
    assert before == after
    plain = {r["tx_id"]: r["a"] for r in D.apply_scaler(rows, ens.scaler, ["tx_id"]).collect()}
    assert {r["tx_id"]: r["a"] for r in again.scale(rows).collect()} == plain and "g" in again.scale(rows).columns


def test_batch_scoring_equals_stream_scoring(spark):
    raw = tx_events(spark, SF).select(*[c for c in TX_COLUMNS if c not in ("isFraud", "isFlaggedFraud")])
    from txrisk.operators import features as C
    from txrisk.operators import prep as D

    fm = C.feature_matrix(C.engineer_features(tx_events(spark, SF)), keep=["tx_id", "isFraud"])
    params = D.fit_scaler(fm)
    train = D.apply_scaler(fm, params, keep=["tx_id", "isFraud"])
    ens = M.Ensemble(M.train_gbt_a(train, rounds=2), M.train_gbt_b(train, rounds=2))
    batch = H.score_end_to_end(raw, ens, params)
    streamed = run_to_table(spark, raw, lambda s: S.stream_score(s, ens, params), chunks=2, timers=True)
    cols = ["tx_id", "fraud_proba", "is_fraud", "risk_level", "alert_reason"]
    assert sorted(map(tuple, batch.select(cols).collect())) == sorted(map(tuple, streamed.select(cols).collect()))


def test_history_of_one_crowded_step(spark, monkeypatch):
    """Nine in ten rows share an origin and a step; ranges of ids split them."""
    monkeypatch.setattr(H, "RANGE_IDS", 7)
    rnd = random.Random(8)
    rows = sorted(
        ((50 if rnd.random() < 0.9 else rnd.randint(1, 100), rnd.choice(["a", "b", "c", "d", None]), float(rnd.randint(1, 9))) for _ in range(300)),
        key=lambda r: r[0],
    )
    tx = spark.createDataFrame(
        [(i, s, "hot", d, a) for i, (s, d, a) in enumerate(rows)], "tx_id long, step int, nameOrig string, nameDest string, amount double"
    )
    got = [tuple(r)[1:] for r in H.history_features(tx).orderBy("tx_id").collect()]
    assert got == _plain_history(rows, 24)
