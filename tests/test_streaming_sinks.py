"""Sinks by batch, and windows made of panes."""

import random

import pytest
from pyspark.sql import functions as F

from txrisk.streaming import stream as S
from txrisk.streaming.sinks import BatchSinks


def test_a_repeated_batch_changes_nothing_and_a_broken_one_is_not_seen(spark, tmp_path):
    fail = [False]

    def odd(b):
        if fail[0]:
            raise RuntimeError("broken off")
        return b.where("v % 2 = 1")

    sinks = BatchSinks(str(tmp_path / "s"), {"all": lambda b: b, "odd": odd, "sum": lambda b: b.agg(F.sum("v").alias("s"))})
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    rows = lambda name, c: sorted(r[c] for r in sinks.read(spark, name).collect())
    sinks(frame(1, 2, 3), 0)
    sinks(frame(1, 2, 3), 0)
    assert (rows("all", "v"), rows("odd", "v"), rows("sum", "s")) == ([1, 2, 3], [1, 3], [6])
    fail[0] = True
    with pytest.raises(RuntimeError):
        sinks(frame(4, 5), 1)
    assert rows("all", "v") == [1, 2, 3]  # written, not committed
    fail[0] = False
    sinks(frame(4, 5), 1)
    assert (rows("all", "v"), rows("odd", "v"), rows("sum", "s")) == ([1, 2, 3, 4, 5], [1, 3, 5], [6, 9])
    with pytest.raises(ValueError):
        sinks.read(spark, "none")


def test_window_graph_equals_every_window_by_itself(spark):
    rnd = random.Random(7)
    panes = {(rnd.randint(1, 40), rnd.choice("ab"), rnd.choice(["a", "c", None])): rnd.randint(1, 999) / 100 for _ in range(60)}
    df = spark.createDataFrame([(*k, v) for k, v in panes.items()], "step int, src string, dst string, amount double")
    for width in (1, 4, 25):
        exp = {}
        for w in range(1 - width, 42):
            last = {}
            for (step, src, dst), amount in sorted(panes.items(), key=lambda p: p[0][0]):
                if w <= step < w + width:
                    last[src, dst] = amount
            for (src, dst), amount in last.items():
                for account, i in ((src, 1), (dst, 0)):
                    if account is not None:
                        row = exp.setdefault((w, account), [0, 0, 0.0, 0.0])
                        row[i] += 1
                        row[2 + i] += amount
        got = {(r[0], r[1]): list(r)[2:] for r in S.window_graph(df, width).collect()}
        assert set(got) == set(exp)
        for k, v in exp.items():
            assert got[k] == pytest.approx(v, abs=1e-9)
