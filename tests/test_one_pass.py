"""Counters of the pass that writes, and distributions from mergeable sketches."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import profile as B
from txrisk.sources import io as A
from txrisk.streaming import runner

REQUEST = (
    "tx_id long, step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, "
    "nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int"
)


def _request(i, **changes):
    row = dict(tx_id=i, step=1, type="CASH_OUT", amount=10.0, nameOrig="a", oldbalanceOrg=1.0, newbalanceOrig=1.0, nameDest="b",
               oldbalanceDest=1.0, newbalanceDest=1.0, isFraud=i % 2)
    return tuple({**row, **changes}.values())


def test_one_pass_writes_both_parts_and_counts_them(spark, tmp_path):
    rows = [_request(1), _request(2), _request(3, amount=0.0), _request(4, step=None, nameDest=None), _request(5, oldbalanceOrg=None)]
    seen = A.write_validated(spark.createDataFrame(rows, REQUEST), str(tmp_path / "r"))
    assert seen == {
        "total": 5, "valid": 2, "rejected": 3, "bad_step": 1, "bad_amount": 1, "bad_type": 0, "bad_nameOrig": 0, "bad_nameDest": 1,
        "fraud_count": 1, "amount": 20.0,
    }
    back = A.read_validated(spark, str(tmp_path / "r"))
    assert {r["tx_id"]: r["valid"] for r in back.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    refused = A.read_validated(spark, str(tmp_path / "r"), valid=False)
    assert {r["tx_id"] for r in refused.collect()} == {3, 4, 5}
    assert "PartitionFilters: [isnotnull(valid" in refused._jdf.queryExecution().toString()
    none = A.write_validated(spark.createDataFrame([], REQUEST).drop("isFraud"), str(tmp_path / "none"))
    assert none["total"] == 0 and none["amount"] == 0.0 and "fraud_count" not in none


def test_merged_sketches_are_those_of_the_whole(spark):
    rnd = np.random.default_rng(4)
    values = np.concatenate((rnd.normal(size=4000), rnd.exponential(50, 4000), np.zeros(2000)))
    frame = pd.DataFrame({"v": values, "isFraud": rnd.integers(0, 2, len(values)), "part": rnd.integers(0, 7, len(values)), "w": np.nan})
    df = spark.createDataFrame(frame)
    k = 256
    parts = [B.distribution_sketches(df.where(F.col("part") == i), ["v", "w"], k=k) for i in range(7)]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    got = {r["label"]: r for r in B.sketched_quartiles(B.merge_distributions(held, k)).collect()}
    assert set(got) == {0, 1}  # "w" holds no number and has no row
    for label, r in got.items():
        own = np.sort(frame.v[frame.isFraud == label].to_numpy())
        assert (r["feature"], r["n"], r["min"], r["max"]) == ("v", len(own), own[0], own[-1])
        assert math.isclose(r["mean"], own.mean(), rel_tol=1e-9)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            low, high = np.searchsorted(own, r[name], "left") / len(own), np.searchsorted(own, r[name], "right") / len(own)
            assert low <= p + 2 * B.sketch_rank_error(k) and high >= p - 2 * B.sketch_rank_error(k)
    assert B.distribution_sketches(df.limit(0), ["v"]).collect() == []


def test_settings_of_a_stream_with_timers_do_not_outlast_its_start(spark):
    class Broken:
        def start(self):
            assert spark.conf.get(runner.NO_DATA_BATCHES) == "false"
            raise RuntimeError("no start")

    before = spark.conf.get(runner.NO_DATA_BATCHES)
    with pytest.raises(RuntimeError):
        runner._start(spark, Broken(), timers=True)
    assert spark.conf.get(runner.NO_DATA_BATCHES) == before
