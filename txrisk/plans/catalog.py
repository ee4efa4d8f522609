"""Registered queries: one per operator of the inventory, each with its oracle SQL.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Every query reads the driver tables (through the FX1 fixture view) so its work
grows with them. Double columns are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators import features as C
from txrisk.operators import metrics as G
from txrisk.operators import prep as D
from txrisk.operators import profile as B
from txrisk.operators import scoring as H
from txrisk.plans.sqlparts import FEAT, RULE, SPLIT, TX, with_
from txrisk.sources import io as A
from txrisk.sources.graph_store import GraphStore
from txrisk.sources.fixtures import tx_events
from txrisk.functions.distributed import checkpointed
from txrisk.session import scratch_path
from txrisk.sources.schema import ACCOUNT_AGGS, FEATURE_COLS, GRAPH_FEATURE_COLS, STREAM_SCHEMA, TX_COLUMNS

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every top-level double column (oracle comparison form)."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (lambda spark, sf_dir: rounded(fn(spark, sf_dir)), sql)
        return fn

    return deco


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_events(spark, sf_dir)


def _feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.engineer_features(_tx(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.temporal_split(_feat(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation input: label + the fixture's stand-in model score."""
    return _tx(spark, sf_dir).select("tx_id", "step", F.col("isFraud").alias("label"), F.col("score_stub").alias("score"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = _tx(spark, sf_dir).withColumnRenamed("score_stub", "ml_proba")
    return H.score_batch(tx, "ml_proba")


# ------------------------------------------------------------------ A
TXCOLS = ", ".join(TX_COLUMNS)


@register("a1_scan_transactions", with_(TX) + f"SELECT {TXCOLS} FROM tx")
def a1_scan_transactions(spark, sf_dir):
    """A CSV file with its columns in another order, read by name."""
    path = scratch_path(spark, "transactions") + ".csv"
    names = sorted(TX_COLUMNS, key=lambda c: c[::-1])
    _tx(spark, sf_dir).select(*names).write.option("header", True).csv(path)
    return A.scan_transactions(spark, path).select(*TX_COLUMNS)


@register(
    "a10_validate_rows",
    with_(TX)
    + """SELECT tx_id, reason IS NULL AS valid, reason FROM (
  SELECT tx_id, nullif(concat_ws('; ',
    CASE WHEN step IS NULL OR step < 0 THEN 'step must be >= 0' END,
    CASE WHEN amount IS NULL OR amount <= 0 THEN 'amount must be > 0' END,
    CASE WHEN type IS NULL THEN 'type is required' END,
    CASE WHEN nameOrig IS NULL THEN 'nameOrig is required' END,
    CASE WHEN nameDest IS NULL THEN 'nameDest is required' END,
    CASE WHEN oldbalanceOrg IS NULL THEN 'oldbalanceOrg is required' END,
    CASE WHEN newbalanceOrig IS NULL THEN 'newbalanceOrig is required' END,
    CASE WHEN oldbalanceDest IS NULL THEN 'oldbalanceDest is required' END,
    CASE WHEN newbalanceDest IS NULL THEN 'newbalanceDest is required' END), '') AS reason FROM tx)""",
)
def a10_validate_rows(spark, sf_dir):
    return A.validate_rows(_tx(spark, sf_dir)).select("tx_id", "valid", "reason")


#: Requests of which some are refused: an amount from which a part is taken, a step before the start, no receiver.
REQ = """rq AS (SELECT * REPLACE (CASE WHEN tx_id % 11 = 3 THEN step - 700 ELSE step END AS step,
  amount - 20 AS amount, CASE WHEN tx_id % 13 = 5 THEN NULL ELSE nameDest END AS nameDest) FROM tx),
rv AS (SELECT *, coalesce(step >= 0, false) AND coalesce(amount > 0, false) AND type IS NOT NULL AND nameOrig IS NOT NULL
  AND nameDest IS NOT NULL AND oldbalanceOrg IS NOT NULL AND newbalanceOrig IS NOT NULL AND oldbalanceDest IS NOT NULL
  AND newbalanceDest IS NOT NULL AS valid FROM rq)"""
_COUNTED = """count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS rejected,
  count(*) FILTER (WHERE step IS NULL OR step < 0) AS bad_step, count(*) FILTER (WHERE amount IS NULL OR amount <= 0) AS bad_amount,
  count(*) FILTER (WHERE type IS NULL) AS bad_type, count(*) FILTER (WHERE nameOrig IS NULL) AS bad_nameOrig,
  count(*) FILTER (WHERE nameDest IS NULL) AS bad_nameDest,
  CAST(coalesce(sum(isFraud) FILTER (WHERE valid), 0) AS BIGINT) AS fraud_count,
  round(coalesce(sum(amount) FILTER (WHERE valid), 0), 6) AS amount"""


def _requests(spark, sf_dir):
    return _tx(spark, sf_dir).select(*TX_COLUMNS).withColumns({
        "step": F.when(F.col("tx_id") % 11 == 3, F.col("step") - 700).otherwise(F.col("step")),
        "amount": F.col("amount") - 20,
        "nameDest": F.when(F.col("tx_id") % 13 == 5, F.lit(None)).otherwise(F.col("nameDest")),
    })


@register(
    "a10_quarantine",
    with_(TX, REQ) + f"SELECT {_COUNTED}, count(*) FILTER (WHERE valid) AS kept, count(*) FILTER (WHERE NOT valid) AS quarantined FROM rv",
)
def a10_quarantine(spark, sf_dir):
    """Valid and quarantined requests written in one pass, the counters of that
    pass, and the rows read back from both parts."""
    path = scratch_path(spark, "requests")
    seen = A.write_validated(_requests(spark, sf_dir), path)
    back = A.read_validated(spark, path)
    return back.agg(
        *[F.lit(v).cast("double" if c == "amount" else "long").alias(c) for c, v in seen.items()], F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("quarantined")
    )


# ------------------------------------------------------------------ B
@register("b1_fraud_rate", with_(TX) + "SELECT round(avg(isFraud), 6) AS fraud_rate FROM tx")
def b1_fraud_rate(spark, sf_dir):
    return B.fraud_rate(_tx(spark, sf_dir))


@register("b2_type_counts", with_(TX) + "SELECT type, count(*) AS n FROM tx GROUP BY type")
def b2_type_counts(spark, sf_dir):
    return B.type_counts(_tx(spark, sf_dir))


@register(
    "b3_fraud_by_type",
    with_(TX)
    + "SELECT type, CAST(sum(isFraud) AS BIGINT) AS fraud, count(*) AS n, round(sum(isFraud) / count(*), 6) AS rate FROM tx GROUP BY type",
)
def b3_fraud_by_type(spark, sf_dir):
    return B.fraud_by_type(_tx(spark, sf_dir))


@register(
    "b4_fraud_by_hour",
    with_(TX)
    + "SELECT step % 24 AS hour_of_day, CAST(sum(isFraud) AS BIGINT) AS fraud, count(*) AS n, round(sum(isFraud) / count(*), 6) AS rate FROM tx GROUP BY 1",
)
def b4_fraud_by_hour(spark, sf_dir):
    return B.fraud_by_hour(_tx(spark, sf_dir))


@register(
    "b5_split_summary",
    with_(TX, FEAT, SPLIT)
    + "SELECT split, count(*) AS n, round(avg(isFraud), 6) AS fraud_rate FROM sp WHERE split IS NOT NULL GROUP BY split",
)
def b5_split_summary(spark, sf_dir):
    return B.split_summary(_split(spark, sf_dir))


@register(
    "b6_kpi_summary",
    with_(TX)
    + "SELECT count(*) AS total, CAST(sum(isFraud) AS BIGINT) AS fraud_count, round(sum(isFraud) / count(*) * 100, 6) AS fraud_pct FROM tx",
)
def b6_kpi_summary(spark, sf_dir):
    return B.kpi_summary(_tx(spark, sf_dir))


@register(
    "b7_log_amount_histogram",
    with_(TX)
    + """, v AS (SELECT isFraud AS label, ln(1 + amount) AS x FROM tx WHERE amount IS NOT NULL),
r AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT label, CAST(least(floor((x - mn) / (CASE WHEN mx > mn THEN mx - mn ELSE 1 END) * 50), 49) AS INTEGER) AS bin,
             mn, CASE WHEN mx > mn THEN mx - mn ELSE 1 END AS span FROM v, r)
SELECT label, bin, round(mn + bin * span / 50, 6) AS bin_lo, round(mn + (bin + 1) * span / 50, 6) AS bin_hi, count(*) AS n
FROM b GROUP BY label, bin, mn, span""",
)
def b7_log_amount_histogram(spark, sf_dir):
    return B.log_amount_histogram(_tx(spark, sf_dir))


@register(
    "b8_distribution_by_class",
    with_(TX)
    + """SELECT 'amount' AS feature, isFraud AS label, count(*) AS n, round(min(ln(1 + amount)), 6) AS min,
  round(quantile_cont(ln(1 + amount), 0.25), 6) AS q1, round(quantile_cont(ln(1 + amount), 0.5), 6) AS median,
  round(quantile_cont(ln(1 + amount), 0.75), 6) AS q3, round(max(ln(1 + amount)), 6) AS max,
  round(avg(ln(1 + amount)), 6) AS mean FROM tx WHERE amount IS NOT NULL GROUP BY isFraud""",
)
def b8_distribution_by_class(spark, sf_dir):
    return B.distribution_by_class(_tx(spark, sf_dir), "amount")


def _distribution_sql(feature: str) -> str:
    v = "ln(1 + amount)" if feature == "amount" else f"CAST({feature} AS DOUBLE)"
    return f"""SELECT '{feature}' AS feature, label, count(*) AS n, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max, round(avg(v), 6) AS mean
FROM (SELECT isFraud AS label, {v} AS v FROM feat) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY label"""


@register(
    "b8_distribution_by_class_all", with_(TX, FEAT) + " UNION ALL ".join(_distribution_sql(c) for c in B.DISTRIBUTION_FEATURES)
)
def b8_distribution_by_class_all(spark, sf_dir):
    """Every selectable feature; ``b8_distribution_by_class`` has the amount alone, as its SQL."""
    feat = _feat(spark, sf_dir)
    return reduce(DataFrame.unionByName, [B.distribution_by_class(feat, c) for c in B.DISTRIBUTION_FEATURES])


@register(
    "b8_distribution_sketch",
    with_(TX, FEAT) + "SELECT feature, label, n, min, max, mean, true AS q1_near, true AS median_near, true AS q3_near FROM ("
    + " UNION ALL ".join(_distribution_sql(c) for c in B.DISTRIBUTION_FEATURES) + ")",
)
def b8_distribution_sketch(spark, sf_dir):
    """Every feature from mergeable sketches: one a month of 30 days, written and merged.
    ``near``: the true rank of the sketched quartile is within twice the stated error."""
    k, feat = 1024, _feat(spark, sf_dir)
    months = feat.withColumn("_class", F.struct(F.col("isFraud").alias("label"), F.floor(F.col("step") / 720).alias("month")))
    path = scratch_path(spark, "sketches")
    B.distribution_sketches(months, label="_class", k=k).write.parquet(path)
    parts = spark.read.parquet(path).withColumn("label", F.col("label.label"))
    found = checkpointed(B.sketched_quartiles(B.merge_distributions(parts, k)))
    values = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.log1p(c) if c == "amount" else F.col(c).cast("double")).alias("v"))
        for c in B.DISTRIBUTION_FEATURES
    ])
    rows = feat.select(F.col("isFraud").alias("label"), F.explode(values).alias("x")).select("label", "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    error = F.lit(2 * B.sketch_rank_error(k))
    near = lambda c, p: (
        (F.count_if(F.col("v") < F.col(c)) / F.count("v") <= p + error) & (F.count_if(F.col("v") <= F.col(c)) / F.count("v") >= p - error)
    )
    return rows.join(found, ["feature", "label"]).groupBy("feature", "label", "n", "min", "max", "mean").agg(
        *[near(c, F.lit(p)).alias(f"{c}_near") for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    )


_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN isnan(corr(CAST({c} AS DOUBLE), CAST(isFraud AS DOUBLE))) THEN NULL "
    f"ELSE round(corr(CAST({c} AS DOUBLE), CAST(isFraud AS DOUBLE)), 6) END AS corr FROM feat"
    for c in B.CORRELATION_COLS
)


@register("b9_label_correlation", with_(TX, FEAT) + _CORR_SQL)
def b9_label_correlation(spark, sf_dir):
    return B.label_correlation(_feat(spark, sf_dir))


_DISTINCT = """smp AS (SELECT * FROM smp0 QUALIFY row_number() OVER (PARTITION BY step, type, amount, nameOrig, oldbalanceOrg,
  newbalanceOrig, nameDest, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud ORDER BY part, tx_id) = 1)"""
HEADS = f"""
smp0 AS (
  (SELECT *, 0 AS part FROM sp WHERE split = 'test' AND isFraud = 1 ORDER BY step, tx_id LIMIT 30)
  UNION ALL
  (SELECT *, 1 AS part FROM sp WHERE split = 'test' AND isFraud = 0 ORDER BY step, tx_id LIMIT 150)),
{_DISTINCT}
"""
WHOLE = f"""
smp0 AS (SELECT *, CASE WHEN isFraud = 1 THEN 0 ELSE 1 END AS part FROM sp WHERE split = 'test'),
{_DISTINCT},
sev AS (SELECT nameOrig AS account, isFraud AS flag, part, step, tx_id, 0 AS role FROM smp
        UNION ALL SELECT nameDest, 0, part, step, tx_id, 1 FROM smp),
snode AS (SELECT account, arg_max(flag, (part, step, tx_id, role)) AS is_fraud FROM sev GROUP BY account),
sedge AS (SELECT nameOrig AS src, nameDest AS dst, arg_max(amount, (part, step, tx_id)) AS amount,
                 arg_max(isFraud, (part, step, tx_id)) AS is_fraud FROM smp GROUP BY nameOrig, nameDest),
sdeg AS (SELECT account, count(*) AS degree FROM (SELECT src AS account FROM sedge UNION ALL SELECT dst FROM sedge) GROUP BY account)
"""


def _test_rows(spark, sf_dir):
    return _split(spark, sf_dir).where(F.col("split") == "test").select(*TX_COLUMNS)


def _network(spark, sf_dir):
    return B.network_rows(_test_rows(spark, sf_dir))


@register(
    "b10_network_sample",
    with_(TX, FEAT, SPLIT, HEADS) + f"SELECT {TXCOLS}, part FROM smp",
)
def b10_network_sample(spark, sf_dir):
    return B.network_sample(_test_rows(spark, sf_dir), 150)


@register(
    "b11_network_summary",
    with_(TX, FEAT, SPLIT, WHOLE)
    + """SELECT (SELECT count(*) FROM snode) AS nodes, (SELECT count(*) FROM sedge) AS edges,
  (SELECT CAST(sum(is_fraud) AS BIGINT) FROM snode) AS fraud_nodes, (SELECT CAST(sum(is_fraud) AS BIGINT) FROM sedge) AS fraud_edges""",
)
def b11_network_summary(spark, sf_dir):
    return B.network_summary(_network(spark, sf_dir))


@register(
    "b12_network_node_style",
    with_(TX, FEAT, SPLIT, WHOLE)
    + """SELECT n.account, n.is_fraud, coalesce(d.degree, 0) AS degree,
  CAST(least(15 + coalesce(d.degree, 0) * 2, 40) AS INTEGER) AS size,
  CASE WHEN n.is_fraud = 1 THEN '#ff4757' ELSE '#57a0ff' END AS color,
  substring(n.account, 1, 6) || '…' AS label
FROM snode n LEFT JOIN sdeg d USING (account)""",
)
def b12_network_node_style(spark, sf_dir):
    return B.network_node_style(_network(spark, sf_dir))


@register(
    "b12_network_edge_style",
    with_(TX, FEAT, SPLIT, WHOLE)
    + """SELECT src, dst, is_fraud, round(least(1 + amount / 100000, CAST(5 AS DOUBLE)), 6) AS width,
  CASE WHEN is_fraud = 1 THEN '#ff4757' ELSE '#aaaaaa' END AS color,
  'Amount: $' || format('{:,.0f}', amount) AS title FROM sedge""",
)
def b12_network_edge_style(spark, sf_dir):
    return B.network_edge_style(_network(spark, sf_dir))


# ------------------------------------------------------------------ C
_FEAT_COLS_SQL = ", ".join(
    f"round({c}, 6) AS {c}" if c not in ("is_round_amount", "has_orig_error", "has_dest_error", "orig_zero_before",
                                         "orig_zero_after", "dest_zero_before", "hour_of_day", "day_of_week",
                                         "step_mod_24", "type_encoded", "orig_tx_count", "orig_unique_dests")
    else c
    for c in C.ENGINEERED_COLS
)


@register(
    "c16_engineer_features",
    with_(TX, FEAT) + f"SELECT tx_id, step, type, round(amount, 6) AS amount, nameOrig, round(oldbalanceOrg, 6) AS oldbalanceOrg, "
    f"round(newbalanceOrig, 6) AS newbalanceOrig, nameDest, round(oldbalanceDest, 6) AS oldbalanceDest, "
    f"round(newbalanceDest, 6) AS newbalanceDest, isFraud, isFlaggedFraud, round(score_stub, 6) AS score_stub, {_FEAT_COLS_SQL} FROM feat",
)
def c16_engineer_features(spark, sf_dir):
    return _feat(spark, sf_dir)


@register(
    "c2_type_amount_stats",
    with_(TX) + "SELECT type, round(avg(amount), 6) AS type_mean, round(stddev_samp(amount), 6) AS type_std FROM tx GROUP BY type",
)
def c2_type_amount_stats(spark, sf_dir):
    return C.type_amount_stats(_tx(spark, sf_dir))


@register(
    "c11_type_index",
    with_(TX) + "SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS type_encoded FROM (SELECT DISTINCT type FROM tx WHERE type IS NOT NULL)",
)
def c11_type_index(spark, sf_dir):
    return C.type_index(_tx(spark, sf_dir))


@register(
    "c12_type_code",
    with_(TX)
    + """SELECT tx_id, type, CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2
  WHEN 'PAYMENT' THEN 3 WHEN 'TRANSFER' THEN 4 ELSE 0 END AS type_code FROM tx""",
)
def c12_type_code(spark, sf_dir):
    from txrisk.functions.columns import type_code

    return _tx(spark, sf_dir).select("tx_id", "type", type_code().alias("type_code"))


@register(
    "c13_origin_stats",
    with_(TX) + "SELECT nameOrig, CAST(count(isFraud) AS BIGINT) AS orig_tx_count, round(sum(amount), 6) AS orig_total_sent, "
    "CAST(count(DISTINCT nameDest) AS BIGINT) AS orig_unique_dests FROM tx GROUP BY nameOrig",
)
def c13_origin_stats(spark, sf_dir):
    return C.origin_stats(_tx(spark, sf_dir))


_FM_SQL = ", ".join(
    f"round(coalesce(CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN 0 ELSE CAST({c} AS DOUBLE) END, 0), 6) AS {c}" for c in FEATURE_COLS
)


@register("c17_feature_matrix", with_(TX, FEAT) + f"SELECT tx_id, isFraud, {_FM_SQL} FROM feat")
def c17_feature_matrix(spark, sf_dir):
    return C.feature_matrix(_feat(spark, sf_dir), keep=["tx_id", "isFraud"])


# ------------------------------------------------------------------ D
@register("d1_temporal_split", with_(TX, FEAT, SPLIT) + "SELECT tx_id, step, split FROM sp")
def d1_temporal_split(spark, sf_dir):
    return D.temporal_split(_tx(spark, sf_dir)).select("tx_id", "step", "split")


FM = "fm AS (SELECT tx_id, isFraud, split, " + _FM_SQL.replace("round(", "(").replace(", 6) AS", ") AS") + " FROM sp)"
SCALER = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS idx, coalesce(avg({c}), 0) AS mean, "
    f"CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN CAST(1 AS DOUBLE) ELSE stddev_pop({c}) END AS scale "
    f"FROM fm WHERE split = 'train'"
    for i, c in enumerate(FEATURE_COLS)
) + ")"


def _fm_split(spark, sf_dir):
    return C.feature_matrix(_split(spark, sf_dir), keep=["tx_id", "isFraud", "split"])


@register(
    "d2_fit_scaler",
    with_(TX, FEAT, SPLIT, FM, SCALER) + "SELECT feature, CAST(idx AS INTEGER) AS idx, round(mean, 6) AS mean, round(scale, 6) AS scale FROM sc",
)
def d2_fit_scaler(spark, sf_dir):
    return D.fit_scaler(_fm_split(spark, sf_dir).where(F.col("split") == "train"))


def _scaled_sql() -> str:
    cols = ", ".join(
        f"round(({c} - (SELECT mean FROM sc WHERE idx = {i})) / (SELECT scale FROM sc WHERE idx = {i}), 6) AS {c}"
        for i, c in enumerate(FEATURE_COLS)
    )
    return f"SELECT tx_id, isFraud, {cols} FROM fm WHERE split = 'test'"


@register("d3_apply_scaler", with_(TX, FEAT, SPLIT, FM, SCALER) + _scaled_sql())
def d3_apply_scaler(spark, sf_dir):
    fm = _fm_split(spark, sf_dir)
    params = D.fit_scaler(fm.where(F.col("split") == "train"))
    return D.apply_scaler(fm.where(F.col("split") == "test"), params, keep=["tx_id", "isFraud"])


@register(
    "d5_pos_weight",
    with_(TX) + "SELECT round(sum(CASE WHEN isFraud = 0 THEN 1 ELSE 0 END) / (sum(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) + CAST(1e-9 AS DOUBLE)), 6) AS pos_weight FROM tx",
)
def d5_pos_weight(spark, sf_dir):
    return D.pos_weight(_tx(spark, sf_dir))


@register(
    "d6_class_weights",
    with_(TX)
    + """, c AS (SELECT isFraud, count(*) AS nc FROM tx GROUP BY isFraud),
t AS (SELECT count(*) AS n, count(DISTINCT isFraud) AS k FROM tx)
SELECT tx.tx_id, tx.isFraud, round(t.n / (t.k * c.nc), 6) AS weight,
       CASE WHEN tx.isFraud = 1 THEN CAST(100 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS fixed_weight
FROM tx JOIN c USING (isFraud), t""",
)
def d6_class_weights(spark, sf_dir):
    tx = _tx(spark, sf_dir).select("tx_id", "isFraud")
    bal = D.class_weights(tx, "balanced")
    return D.class_weights(bal, "fixed", output="fixed_weight").select("tx_id", "isFraud", "weight", "fixed_weight")


# ------------------------------------------------------------------ G, F6, F7
SC = "s AS (SELECT tx_id, step, isFraud AS label, score_stub AS score FROM tx)"
CUM = """
cs AS (SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
              CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM s WHERE score IS NOT NULL GROUP BY score),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                 sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM cs),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM cs)
"""


@register(
    "g1_pr_curve",
    with_(TX, SC, CUM)
    + """SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM cu, tot
UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)""",
)
def g1_pr_curve(spark, sf_dir):
    return G.pr_curve(_scored(spark, sf_dir))


@register(
    "g2_roc_curve",
    with_(TX, SC, CUM)
    + """SELECT round(score, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM cu, tot
UNION ALL SELECT NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
)
def g2_roc_curve(spark, sf_dir):
    return G.roc_curve(_scored(spark, sf_dir))


RANK_SQL = """SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS auprc,
  round(sum(neg * (2 * tp - pos)) / (2 * sum(pos) * sum(neg)), 6) AS auc_roc FROM cu"""


@register("g3_average_precision", with_(TX, SC, CUM) + "SELECT auprc FROM (" + RANK_SQL + ")")
def g3_average_precision(spark, sf_dir):
    return G.average_precision(_scored(spark, sf_dir))


@register("g4_auc_roc", with_(TX, SC, CUM) + "SELECT auc_roc FROM (" + RANK_SQL + ")")
def g4_auc_roc(spark, sf_dir):
    return G.auc_roc(_scored(spark, sf_dir))


CONF = """cm AS (SELECT
  CAST(sum(CASE WHEN label <> 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label <> 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM s)"""


@register("g5_confusion", with_(TX, SC, CONF) + "SELECT * FROM cm")
def g5_confusion(spark, sf_dir):
    return G.confusion(_scored(spark, sf_dir), 0.5)


PRF = """SELECT tn, fp, fn, tp, round(tp / (tp + fp + CAST(1e-9 AS DOUBLE)), 6) AS precision,
  round(tp / (tp + fn + CAST(1e-9 AS DOUBLE)), 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM cm"""


@register("g6_precision_recall_f1", with_(TX, SC, CONF) + PRF.replace("2.0 *", "CAST(2 AS DOUBLE) *"))
def g6_precision_recall_f1(spark, sf_dir):
    return G.precision_recall_f1(_scored(spark, sf_dir), 0.5)


@register(
    "g7_classification_report",
    with_(TX, SC, CONF)
    + """, m AS (SELECT CAST(tn AS DOUBLE) tn, CAST(fp AS DOUBLE) fp, CAST(fn AS DOUBLE) fn, CAST(tp AS DOUBLE) tp FROM cm),
k AS (SELECT *, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END r0,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END r1,
  tn + fp AS s0, tp + fn AS s1 FROM m),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END f0,
  CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END f1, s0 + s1 AS n FROM k)
SELECT 'Legit' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT 'Fraud', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN n > 0 THEN (tn + tp) / n ELSE 0 END, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6), round((f0 * s0 + f1 * s1) / n, 6), CAST(n AS BIGINT) FROM f""",
)
def g7_classification_report(spark, sf_dir):
    return G.classification_report(_scored(spark, sf_dir), 0.5)


@register(
    "g8_score_histogram",
    with_(TX, SC)
    + """, i AS (SELECT label, CAST(least(floor(score * 49), 48) AS INTEGER) AS bin FROM s WHERE score >= 0 AND score <= 1),
c AS (SELECT label, bin, count(*) AS n FROM i GROUP BY label, bin),
t AS (SELECT label, count(*) AS NN FROM i GROUP BY label),
g AS (SELECT t.label, t.NN, CAST(b.range AS INTEGER) AS bin FROM t, range(0, 49) b)
SELECT g.label, g.bin, round(g.bin * (1.0 / 49), 6) AS bin_lo, round((g.bin + 1) * (1.0 / 49), 6) AS bin_hi,
  coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (g.NN * (1.0 / 49)), 6) AS density
FROM g LEFT JOIN c USING (label, bin)""".replace("1.0 / 49", "CAST(1 AS DOUBLE) / 49"),
)
def g8_score_histogram(spark, sf_dir):
    return G.score_histogram(_scored(spark, sf_dir))


def _sweep_sql() -> str:
    ts = G.sweep_thresholds()
    values = ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(ts))
    return (
        with_(TX, SC)
        + f""", th(i, threshold) AS (VALUES {values}),
tot AS (SELECT sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P FROM s),
c AS (SELECT th.i, th.threshold,
  CAST(sum(CASE WHEN s.label = 1 AND s.score >= th.threshold THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN s.label <> 1 AND s.score >= th.threshold THEN 1 ELSE 0 END) AS DOUBLE) AS fp
  FROM th, s GROUP BY th.i, th.threshold),
m AS (SELECT i, threshold, tp / (tp + fp + CAST(1e-9 AS DOUBLE)) AS precision,
  tp / (tp + (P - tp) + CAST(1e-9 AS DOUBLE)) AS recall FROM c, tot),
f AS (SELECT *, 2 * precision * recall / (precision + recall + CAST(1e-9 AS DOUBLE)) AS f1 FROM m)
SELECT CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, i = (SELECT i FROM f ORDER BY f1 DESC, i LIMIT 1) AS is_best FROM f"""
    )


@register("g9_threshold_sweep", _sweep_sql())
def g9_threshold_sweep(spark, sf_dir):
    return G.threshold_sweep(_scored(spark, sf_dir))


@register(
    "g10_focal_loss",
    with_(TX, SC)
    + """, l AS (SELECT CAST(label AS DOUBLE) AS y, ln((score + CAST(0.01 AS DOUBLE)) / (CAST(1.01 AS DOUBLE) - score)) AS x FROM s),
b AS (SELECT CAST(2 AS DOUBLE) * y * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + (1 - y) * (greatest(x, 0) + ln(1 + exp(-abs(x)))) AS bce FROM l)
SELECT round(avg(CAST(0.25 AS DOUBLE) * pow(1 - exp(-bce), 2) * bce), 6) AS focal_loss FROM b""",
)
def g10_focal_loss(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("logit", F.log((F.col("score") + 0.01) / (F.lit(1.01) - F.col("score"))))
    return G.focal_loss(s, "logit", "label", 0.25, 2.0, pos_weight=2.0)


@register(
    "g11_evaluate",
    with_(TX, "s0 AS (SELECT tx_id, step, isFraud AS label, score_stub AS score FROM tx)",
          "s AS (SELECT * FROM s0 WHERE step > 672)", CUM, CONF)
    + """, rk AS (SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS auprc, sum(neg * (2 * tp - pos)) / (2 * sum(pos) * sum(neg)) AS auc_roc FROM cu)
SELECT 'Test' AS split, round(auprc, 4) AS auprc, round(auc_roc, 4) AS auc_roc,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 AS DOUBLE) * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1,
  round(tp / (tp + fp + CAST(1e-9 AS DOUBLE)), 4) AS precision, round(tp / (tp + fn + CAST(1e-9 AS DOUBLE)), 4) AS recall,
  tp, fp, tn, fn, CAST(0.5 AS DOUBLE) AS threshold FROM rk, cm""",
)
def g11_evaluate(spark, sf_dir):
    s = _scored(spark, sf_dir).where(F.col("step") > 672)
    return G.evaluate(s, 0.5, "Test")


@register("g12_pr_baseline", with_(TX) + "SELECT round(avg(CAST(isFraud AS DOUBLE)), 6) AS pr_baseline FROM tx")
def g12_pr_baseline(spark, sf_dir):
    return G.pr_baseline(_scored(spark, sf_dir))


@register("f6_predict", with_(TX) + "SELECT tx_id, CAST(score_stub >= 0.5 AS INTEGER) AS prediction FROM tx")
def f6_predict(spark, sf_dir):
    return G.predict(_scored(spark, sf_dir), 0.5).select("tx_id", "prediction")


@register(
    "f7_tune_threshold",
    with_(TX, SC, CUM)
    + """, pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM cu, tot),
f AS (SELECT *, 2 * precision * recall / (precision + recall + CAST(1e-9 AS DOUBLE)) AS f1 FROM pr)
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM f ORDER BY f1 DESC, threshold ASC LIMIT 1""",
)
def f7_tune_threshold(spark, sf_dir):
    return G.tune_threshold(_scored(spark, sf_dir))


# ------------------------------------------------------------------ H
@register(
    "h1_history_features",
    with_(TX)
    + """, h AS (SELECT a.tx_id, a.amount, count(b.tx_id) AS n, sum(b.amount) AS s, count(DISTINCT b.nameDest) AS d
  FROM tx a LEFT JOIN tx b ON a.nameOrig = b.nameOrig AND ((b.step >= a.step - 24 AND b.step < a.step) OR (b.step = a.step AND b.tx_id < a.tx_id))
  GROUP BY a.tx_id, a.amount)
SELECT tx_id, CAST(n + 1 AS BIGINT) AS orig_tx_count, round(coalesce(s, 0) + amount, 6) AS orig_total_sent,
  CAST(CASE WHEN n > 0 THEN d ELSE 1 END AS BIGINT) AS orig_unique_dests FROM h""",
)
def h1_history_features(spark, sf_dir):
    return H.history_features(_tx(spark, sf_dir))


@register("h3_rule_score", with_(TX, RULE) + "SELECT tx_id, round(rule_score, 6) AS rule_score FROM ru")
def h3_rule_score(spark, sf_dir):
    from txrisk.functions.columns import rule_score

    return _tx(spark, sf_dir).select("tx_id", rule_score().alias("rule_score"))


@register("h4_risk_level", with_(TX, RULE) + "SELECT tx_id, risk_level FROM al")
def h4_risk_level(spark, sf_dir):
    return _alerts(spark, sf_dir).select("tx_id", "risk_level")


@register("h5_alert_reason", with_(TX, RULE) + "SELECT tx_id, alert_reason FROM al")
def h5_alert_reason(spark, sf_dir):
    return _alerts(spark, sf_dir).select("tx_id", "alert_reason")


@register(
    "h6_blend_rule",
    with_(TX, RULE) + "SELECT tx_id, fraud_proba, is_fraud FROM al",
)
def h6_blend_rule(spark, sf_dir):
    return _alerts(spark, sf_dir).select("tx_id", "fraud_proba", "is_fraud")


_AL_COLS = (
    "tx_id, step, type, round(amount, 6) AS amount, nameOrig, round(oldbalanceOrg, 6) AS oldbalanceOrg, "
    "round(newbalanceOrig, 6) AS newbalanceOrig, nameDest, round(oldbalanceDest, 6) AS oldbalanceDest, "
    "round(newbalanceDest, 6) AS newbalanceDest, isFraud, isFlaggedFraud, round(rule_score, 6) AS rule_score, "
    "fraud_proba, is_fraud, risk_level, alert_reason"
)


@register("h8_score_batch", with_(TX, RULE) + f"SELECT {_AL_COLS} FROM al")
def h8_score_batch(spark, sf_dir):
    return _alerts(spark, sf_dir)


@register(
    "h9_alert_stats",
    with_(TX, RULE)
    + """SELECT count(*) AS total_scored, CAST(sum(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS total_alerts,
  round(sum(CASE WHEN is_fraud THEN 1 ELSE 0 END) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS alert_rate FROM al""",
)
def h9_alert_stats(spark, sf_dir):
    return H.alert_stats(_alerts(spark, sf_dir))


@register(
    "h10_recent_alerts",
    with_(TX, RULE)
    + """SELECT tx_id, step, substring(nameOrig, 1, 12) AS account, round(amount, 6) AS amount, type, fraud_proba, risk_level
FROM al WHERE fraud_proba >= CAST(0.7 AS DOUBLE) ORDER BY step DESC, tx_id DESC LIMIT 20""",
)
def h10_recent_alerts(spark, sf_dir):
    return H.recent_alerts(_alerts(spark, sf_dir))


@register(
    "h10_alert_counts",
    with_(TX, RULE)
    + """SELECT count(*) AS processed, CAST(sum(CASE WHEN fraud_proba >= CAST(0.7 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  CAST(sum(CASE WHEN fraud_proba >= CAST(0.7 AS DOUBLE) AND risk_level IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END) AS BIGINT) AS high FROM al""",
)
def h10_alert_counts(spark, sf_dir):
    return H.alert_counts(_alerts(spark, sf_dir))


@register(
    "h8_alerts_by_type_level",
    with_(TX, RULE)
    + """SELECT type, risk_level, count(*) AS n, CAST(sum(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
  round(avg(rule_score), 6) AS avg_rule_score FROM al GROUP BY type, risk_level""",
)
def h8_alerts_by_type_level(spark, sf_dir):
    """Flagship: which transactions the rules + score flag, per type and risk level."""
    return alerts_by_type_level(_alerts(spark, sf_dir))


def alerts_by_type_level(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("type", "risk_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("is_fraud"), 1).otherwise(0)).cast("long").alias("alerts"),
        F.avg("rule_score").alias("avg_rule_score"),
    )


# ------------------------------------------------------------------ E (graph)
from txrisk.operators import centrality as EC  # noqa: E402
from txrisk.operators import graph as E  # noqa: E402
from txrisk.operators import node_model as EN  # noqa: E402
from txrisk.operators import propagate as EP  # noqa: E402
from txrisk.plans.sqlparts import GRAPH, betweenness_sql, pagerank_sql  # noqa: E402

PR_ITERS = 30  # fixed-iteration mode for the oracle comparison


def _graph(spark, sf_dir):
    feat = _feat(spark, sf_dir)
    return feat, E.nodes(feat), E.edges(feat)


@register("e1_nodes", with_(TX, FEAT, GRAPH) + "SELECT account FROM nd")
def e1_nodes(spark, sf_dir):
    return E.nodes(_tx(spark, sf_dir))


@register("e2_edges", with_(TX, FEAT, GRAPH) + "SELECT src, dst, round(amount, 6) AS amount, round(amount_log, 6) AS amount_log, step, tx_type, is_fraud FROM ed")
def e2_edges(spark, sf_dir):
    return E.edges(_feat(spark, sf_dir))


@register("e3_account_labels", with_(TX, FEAT, GRAPH) + "SELECT account, is_fraud FROM lb")
def e3_account_labels(spark, sf_dir):
    return E.account_labels(_tx(spark, sf_dir))


@register(
    "e4_degrees",
    with_(TX, FEAT, GRAPH)
    + "SELECT account, in_degree, out_degree, degree, round(weighted_in_deg, 6) AS weighted_in_deg, round(weighted_out_deg, 6) AS weighted_out_deg FROM dg",
)
def e4_degrees(spark, sf_dir):
    return E.degrees(E.edges(_feat(spark, sf_dir)))


@register("e6_pagerank", with_(TX, FEAT, GRAPH, pagerank_sql(PR_ITERS)) + f"SELECT account, round(x, 6) AS pagerank FROM p{PR_ITERS}")
def e6_pagerank(spark, sf_dir):
    _f, nd, ed = _graph(spark, sf_dir)
    return EC.pagerank(ed, nd, iterations=PR_ITERS)


@register("e8_clustering", with_(TX, FEAT, GRAPH) + "SELECT account, round(clustering_coeff, 6) AS clustering_coeff FROM cc")
def e8_clustering(spark, sf_dir):
    return E.clustering(E.edges(_feat(spark, sf_dir)))


@register("e9_avg_neighbor_degree", with_(TX, FEAT, GRAPH) + "SELECT account, round(avg_neighbor_deg, 6) AS avg_neighbor_deg FROM an")
def e9_avg_neighbor_degree(spark, sf_dir):
    return E.avg_neighbor_degree(E.edges(_feat(spark, sf_dir)))


@register("e10_local_fraud_rate", with_(TX, FEAT, GRAPH) + "SELECT account, round(local_fraud_rate, 6) AS local_fraud_rate FROM lf")
def e10_local_fraud_rate(spark, sf_dir):
    feat, nd, ed = _graph(spark, sf_dir)
    return E.local_fraud_rate(ed, E.account_labels(feat, nd))


GF_SELECT = """SELECT lb.account,
  CAST(coalesce(dg.in_degree, 0) AS DOUBLE) AS in_degree, CAST(coalesce(dg.out_degree, 0) AS DOUBLE) AS out_degree,
  CAST(coalesce(dg.degree, 0) AS DOUBLE) AS degree, coalesce(dg.weighted_in_deg, 0) AS weighted_in_deg,
  coalesce(dg.weighted_out_deg, 0) AS weighted_out_deg, coalesce(pr.x, 0) AS pagerank,
  coalesce(bt.b, 0) / ((nn.N - 1) * (nn.N - 2)) AS betweenness,
  coalesce(cc.clustering_coeff, 0) AS clustering_coeff, coalesce(an.avg_neighbor_deg, 0) AS avg_neighbor_deg,
  coalesce(lf.local_fraud_rate, 0) AS local_fraud_rate, lb.is_fraud
FROM nn, lb LEFT JOIN bt USING (account) LEFT JOIN dg USING (account) LEFT JOIN p{it} pr USING (account) LEFT JOIN cc USING (account)
  LEFT JOIN an USING (account) LEFT JOIN lf USING (account)"""


def _r6_all(inner: str, cols: list[str], keep: list[str]) -> str:
    return "SELECT " + ", ".join(keep + [f"round({c}, 6) AS {c}" for c in cols]) + f" FROM ({inner})"


_GF_COLS = list(GRAPH_FEATURE_COLS)
BETWEENNESS_HOPS = 20  # rounds of the unrolled SQL; paths of the fixture are shorter


@register(
    "e7_betweenness",
    with_(TX, FEAT, GRAPH, betweenness_sql(BETWEENNESS_HOPS))
    + """SELECT nd.account, round(coalesce(bt.b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness
FROM nd LEFT JOIN bt USING (account), (SELECT CAST(count(*) AS DOUBLE) AS n FROM nd)""",
)
def e7_betweenness(spark, sf_dir):
    _f, nd, ed = _graph(spark, sf_dir)
    return EC.betweenness(ed, nd, exact=True)


_E11_SQL = with_(TX, FEAT, GRAPH, pagerank_sql(PR_ITERS), betweenness_sql(BETWEENNESS_HOPS)) + _r6_all(
    GF_SELECT.format(it=PR_ITERS), _GF_COLS, ["account", "is_fraud"]
)


@register("e11_graph_features", _E11_SQL)
def e11_graph_features(spark, sf_dir):
    return E.graph_features(_feat(spark, sf_dir), pagerank_iterations=PR_ITERS, betweenness_k=None)


register("e11_graph_features_full", _E11_SQL)(e11_graph_features)


AA_SQL = """aa AS (SELECT nameOrig AS account, avg(amount) AS amount, avg(amount_log) AS amount_log,
  avg(balance_diff_orig) AS balance_diff_orig, avg(balance_diff_dest) AS balance_diff_dest,
  CAST(max(orig_tx_count) AS DOUBLE) AS orig_tx_count, CAST(max(orig_total_sent) AS DOUBLE) AS orig_total_sent,
  CAST(max(orig_unique_dests) AS DOUBLE) AS orig_unique_dests, avg(type_encoded) AS type_encoded FROM feat GROUP BY nameOrig)"""
_AA_COLS = [c for c, _ in ACCOUNT_AGGS]


@register("e12_account_aggregates", with_(TX, FEAT, AA_SQL) + _r6_all("SELECT * FROM aa", _AA_COLS, ["account"]))
def e12_account_aggregates(spark, sf_dir):
    return E.account_aggregates(_feat(spark, sf_dir))


_E13_SQL = with_(
    TX, FEAT, GRAPH, pagerank_sql(PR_ITERS), betweenness_sql(BETWEENNESS_HOPS), AA_SQL,
    "gf AS (" + GF_SELECT.format(it=PR_ITERS) + ")",
) + _r6_all(
    "SELECT gf.account, gf.is_fraud, " + ", ".join(f"gf.{c}" for c in _GF_COLS) + ", "
    + ", ".join(f"coalesce(aa.{c}, 0) AS {c}" for c in _AA_COLS) + " FROM gf LEFT JOIN aa USING (account)",
    _GF_COLS + _AA_COLS, ["account", "is_fraud"],
)


def _node_features(feat: DataFrame, pagerank_iterations: int | None = None, **pivots) -> DataFrame:
    gf = E.graph_features(feat, pagerank_iterations=pagerank_iterations, **pivots)
    return E.node_features(gf, E.account_aggregates(feat)).drop("x")


@register("e13_node_features", _E13_SQL)
def e13_node_features(spark, sf_dir):
    """All 18 features, betweenness from every node."""
    return _node_features(_feat(spark, sf_dir), PR_ITERS, betweenness_k=None)


register("e13_node_features_full", _E13_SQL)(e13_node_features)


@register(
    "e14_edge_attributes",
    with_(TX, FEAT, GRAPH)
    + "SELECT src, dst, round(amount_log, 6) AS amount_log, CAST(tx_type AS DOUBLE) AS tx_type, round(step / CAST(744 AS DOUBLE), 6) AS step_norm, CAST(is_fraud AS DOUBLE) AS is_fraud FROM ed",
)
def e14_edge_attributes(spark, sf_dir):
    return E.edge_attributes(E.edges(_feat(spark, sf_dir)))


@register(
    "e15_temporal_subgraph",
    with_(TX, FEAT, GRAPH) + "SELECT src, dst, round(amount, 6) AS amount, step FROM ed WHERE step BETWEEN 336 AND 360",
)
def e15_temporal_subgraph(spark, sf_dir):
    sub, _ends = E.temporal_subgraph(E.edges(_feat(spark, sf_dir)), 360, 24)
    return sub.select("src", "dst", "amount", "step")


SEEDS_SQL = """sc AS (SELECT is_fraud, count(*) AS nc FROM lb GROUP BY is_fraud),
sr AS (SELECT lb.account, lb.is_fraud, row_number() OVER (PARTITION BY lb.is_fraud ORDER BY md5(lb.account || '|42'), lb.account) AS rn FROM lb),
seeds AS (SELECT account FROM sr JOIN sc USING (is_fraud) WHERE rn > round(CAST(0.15 AS DOUBLE) * nc))"""


def _sample_sql() -> str:
    hops = []
    prev = "(SELECT account AS seed_account, account AS node FROM seeds)"
    for h, k in enumerate(E.SAMPLE_FANOUTS, start=1):
        hops.append(
            f"""h{h} AS (SELECT seed_account, {h} AS hop, node, nbr FROM (
  SELECT f.seed_account, f.node, ed.src AS nbr, row_number() OVER (PARTITION BY f.seed_account, f.node
    ORDER BY md5(f.seed_account || '|' || f.node || '|' || ed.src || '|{h}|42'), ed.src) AS r
  FROM (SELECT DISTINCT seed_account, node FROM {prev}) f JOIN ed ON ed.dst = f.node) WHERE r <= {k})"""
        )
        prev = f"(SELECT seed_account, nbr AS node FROM h{h})"
    body = ",\n".join(hops)
    union = " UNION ALL ".join(f"SELECT * FROM h{h}" for h in range(1, len(E.SAMPLE_FANOUTS) + 1))
    return with_(TX, FEAT, GRAPH, SEEDS_SQL, body) + f"SELECT seed_account, CAST(hop AS INTEGER) AS hop, node, nbr FROM ({union})"


@register("e16_sample_neighbors", _sample_sql())
def e16_sample_neighbors(spark, sf_dir):
    feat, nd, ed = _graph(spark, sf_dir)
    seeds = D.stratified_split(E.account_labels(feat, nd)).where(F.col("fold") == "train")
    return E.sample_neighbors(ed, seeds)


_X_COLS = ["in_degree", "out_degree", "log_w_in", "log_w_out"]
XN_SQL = (
    "xn AS (SELECT nd.account, CAST(coalesce(dg.in_degree, 0) AS DOUBLE) AS in_degree, "
    "CAST(coalesce(dg.out_degree, 0) AS DOUBLE) AS out_degree, ln(1 + coalesce(dg.weighted_in_deg, 0)) AS log_w_in, "
    "ln(1 + coalesce(dg.weighted_out_deg, 0)) AS log_w_out FROM nd LEFT JOIN dg USING (account))"
)


def _x(spark, sf_dir):
    """Node vectors for the aggregation operators: degrees and log weighted degrees."""
    _f, nd, ed = _graph(spark, sf_dir)
    deg = E.degrees(ed)
    x = nd.join(deg, "account", "left").select(
        "account",
        F.coalesce(F.col("in_degree"), F.lit(0)).cast("double").alias("in_degree"),
        F.coalesce(F.col("out_degree"), F.lit(0)).cast("double").alias("out_degree"),
        F.log1p(F.coalesce(F.col("weighted_in_deg"), F.lit(0.0))).alias("log_w_in"),
        F.log1p(F.coalesce(F.col("weighted_out_deg"), F.lit(0.0))).alias("log_w_out"),
    )
    return ed, x


def _agg_sql(fn: str) -> str:
    cols = ", ".join(f"round(coalesce({fn}(x.{c}), 0), 6) AS {c}" for c in _X_COLS)
    return f"SELECT nd.account, {cols} FROM nd LEFT JOIN ed ON ed.dst = nd.account LEFT JOIN xn x ON x.account = ed.src GROUP BY nd.account"


@register("e17_aggregate_neighbors_mean", with_(TX, FEAT, GRAPH, XN_SQL) + _agg_sql("avg"))
def e17_aggregate_neighbors_mean(spark, sf_dir):
    ed, x = _x(spark, sf_dir)
    return EP.aggregate_neighbors(ed, x, _X_COLS, "mean")


@register("e17_aggregate_neighbors_max", with_(TX, FEAT, GRAPH, XN_SQL) + _agg_sql("max"))
def e17_aggregate_neighbors_max(spark, sf_dir):
    ed, x = _x(spark, sf_dir)
    return EP.aggregate_neighbors(ed, x, _X_COLS, "max")


def _graph_store(x: DataFrame, ed: DataFrame, nd: DataFrame | None = None) -> GraphStore:
    """The graph in bucketed tables, and its node vectors ``x``."""
    name = "txrisk_" + uuid.uuid4().hex[:12]
    nd = x.select("account") if nd is None else nd
    return GraphStore.write(nd, ed, x, name, scratch_path(ed.sparkSession, "graph-store"))


def _stored(spark, sf_dir):
    _f, nd, ed = _graph(spark, sf_dir)
    _e, x = _x(spark, sf_dir)
    return _graph_store(x, ed, nd)


@register("e17_stored_graph", with_(TX, FEAT, GRAPH, XN_SQL) + _agg_sql("avg"))
def e17_stored_graph(spark, sf_dir):
    """E17 on the written graph (A5): edges are read in their buckets and not shuffled."""
    store = _stored(spark, sf_dir)
    return EP.aggregate_neighbors(store, store.features(), _X_COLS, "mean")


GCN_SQL = """pl AS (SELECT DISTINCT snd, rcv FROM (SELECT src AS snd, dst AS rcv FROM ed UNION ALL SELECT account, account FROM nd)),
gd AS (SELECT rcv AS account, CAST(count(*) AS DOUBLE) AS d FROM pl GROUP BY rcv)"""


@register(
    "e18_aggregate_gcn",
    with_(TX, FEAT, GRAPH, XN_SQL, GCN_SQL)
    + "SELECT nd.account, " + ", ".join(f"round(coalesce(s.{c}, 0), 6) AS {c}" for c in _X_COLS)
    + " FROM nd LEFT JOIN (SELECT pl.rcv AS account, "
    + ", ".join(f"sum(pow(a.d, -0.5) * pow(b.d, -0.5) * x.{c}) AS {c}" for c in _X_COLS)
    + " FROM pl JOIN gd a ON a.account = pl.snd JOIN gd b ON b.account = pl.rcv JOIN xn x ON x.account = pl.snd GROUP BY pl.rcv) s USING (account)",
)
def e18_aggregate_gcn(spark, sf_dir):
    ed, x = _x(spark, sf_dir)
    return EP.aggregate_gcn(ed, x, _X_COLS)


@register("e18_stored_graph", QUERIES["e18_aggregate_gcn"][1])
def e18_stored_graph(spark, sf_dir):
    """E18 on the written graph (A5)."""
    store = _stored(spark, sf_dir)
    return EP.aggregate_gcn(store, store.features(), _X_COLS)


_A_SRC = [0.01, -0.02, 0.1, 0.2]
_A_DST = [-0.01, 0.03, 0.2, -0.1]


def _gat_sql() -> str:
    ds = " + ".join(f"CAST({a!r} AS DOUBLE) * xs.{c}" for a, c in zip(_A_SRC, _X_COLS))
    dd = " + ".join(f"CAST({a!r} AS DOUBLE) * xd.{c}" for a, c in zip(_A_DST, _X_COLS))
    sel = ", ".join(f"xs.{c}" for c in _X_COLS)
    return (
        with_(TX, FEAT, GRAPH, XN_SQL)
        + f""", pl AS (SELECT DISTINCT snd, rcv FROM (SELECT src AS snd, dst AS rcv FROM ed WHERE src <> dst UNION ALL SELECT account, account FROM nd)),
k AS (SELECT pl.rcv, {sel}, (CAST(0 AS DOUBLE) + {ds}) + (CAST(0 AS DOUBLE) + {dd}) AS raw
  FROM pl JOIN xn xs ON xs.account = pl.snd JOIN xn xd ON xd.account = pl.rcv),
z AS (SELECT *, CASE WHEN raw >= 0 THEN raw ELSE raw * CAST(0.2 AS DOUBLE) END AS zz FROM k),
m AS (SELECT rcv, max(zz) AS mz FROM z GROUP BY rcv),
e AS (SELECT z.*, exp(zz - mz) AS ex FROM z JOIN m USING (rcv))
SELECT nd.account, """
        + ", ".join(f"round(coalesce(s.{c} / s.den, 0), 6) AS {c}" for c in _X_COLS)
        + " FROM nd LEFT JOIN (SELECT rcv AS account, sum(ex) AS den, "
        + ", ".join(f"sum(ex * {c}) AS {c}" for c in _X_COLS)
        + " FROM e GROUP BY rcv) s USING (account)"
    )


@register("e19_aggregate_attention", _gat_sql())
def e19_aggregate_attention(spark, sf_dir):
    ed, x = _x(spark, sf_dir)
    return EP.aggregate_attention(ed, x, _X_COLS, _A_SRC, _A_DST)


@register("e20_node_scores")
def e20_node_scores(spark, sf_dir):
    return _node_scores(spark, sf_dir).select("account", "is_fraud", "fold", "gnn_proba")


_DEGREE_COLS = ["in_degree", "out_degree", "weighted_in_deg", "weighted_out_deg"]


def _degree_nodes(feat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with degrees and account aggregates, and the edges of a graph."""
    ed = E.edges(feat).persist()
    joined = E.account_labels(feat).join(E.degrees(ed), "account", "left").join(E.account_aggregates(feat), "account", "left")
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _DEGREE_COLS + _AA_COLS]
    return checkpointed(joined.select("account", "is_fraud", *cols)), ed


@register("e20_save_load_by_method")
def e20_save_load_by_method(spark, sf_dir):
    """Each aggregation fitted on the graph of the training split, saved, loaded and applied to the graph of all
    rows, which it has not seen; ``before`` are the scores of the model that was saved."""
    nodes, edges = _degree_nodes(_split(spark, sf_dir).where("split = 'train'").drop("split"))
    later, later_edges = _degree_nodes(_feat(spark, sf_dir))
    edges, later_edges = _graph_store(nodes, edges), _graph_store(later, later_edges)  # read in each of 18 rounds or more
    rows = []
    for method in EP.AGGREGATORS:
        model = EN.NodeClassifier(inputCols=_DEGREE_COLS + _AA_COLS, method=method, hops=2).on_edges(edges).fit(nodes)
        path = scratch_path(spark, f"node-model-{method}")
        model.write().save(path)
        before = model.on_edges(later_edges).transform(later).withColumnRenamed("gnn_proba", "before")
        after = EN.NodeClassifierModel.load(path).on_edges(later_edges).transform(later).withColumnRenamed("gnn_proba", "after")
        rows.append(checkpointed(before.join(after, "account").select(F.lit(method).alias("method"), "*")))
    return reduce(DataFrame.unionByName, rows)


@register("e20_validation_metrics")
def e20_validation_metrics(spark, sf_dir):
    """The graph model on its validation fold."""
    val = _node_scores(spark, sf_dir).where(F.col("fold") == "val")
    return G.evaluate(val.select(F.col("is_fraud").alias("label"), F.col("gnn_proba").alias("score")), 0.5, "Val")


@register(
    "e21_join_node_scores",
    with_(TX, FEAT, GRAPH) + "SELECT tx.tx_id, tx.nameOrig, round(lf.local_fraud_rate, 6) AS gnn_proba FROM tx LEFT JOIN lf ON lf.account = tx.nameOrig",
)
def e21_join_node_scores(spark, sf_dir):
    feat, nd, ed = _graph(spark, sf_dir)
    scores = E.local_fraud_rate(ed, E.account_labels(feat, nd)).withColumnRenamed("local_fraud_rate", "gnn_proba")
    return E.join_node_scores(_tx(spark, sf_dir).select("tx_id", "nameOrig"), scores)


# ------------------------------------------------------------------ D4, D7, D8, F, A sinks
from txrisk.operators import models as M  # noqa: E402
from txrisk.operators import resample as R  # noqa: E402

def _model_frames(spark, sf_dir):
    """Scaled model matrix per split (scaler fitted on train, as in the reference)."""
    fm = C.feature_matrix(_split(spark, sf_dir), keep=["tx_id", "isFraud", "split", "nameOrig"]).persist()
    params = D.fit_scaler(fm.where(F.col("split") == "train"))  # fills the cache that every use scales from
    scaled = D.apply_scaler(fm, params, keep=["tx_id", "isFraud", "split", "nameOrig"])
    return (scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "val"),
            scaled.where(F.col("split") == "test"))


@register("d4_smote")
def d4_smote(spark, sf_dir):
    train, _v, _t = _model_frames(spark, sf_dir)
    return R.smote(train.drop("split", "nameOrig"), "isFraud")


@register(
    "d4_smote_counts",
    with_(TX, FEAT, SPLIT)
    + """, c AS (SELECT sum(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) AS mi, sum(CASE WHEN isFraud = 0 THEN 1 ELSE 0 END) AS ma, count(*) AS n
  FROM sp WHERE split = 'train')
SELECT false AS synthetic, n FROM c UNION ALL SELECT true, CAST(floor(CAST(0.1 AS DOUBLE) * ma - mi) AS BIGINT) FROM c""",
)
def d4_smote_counts(spark, sf_dir):
    return d4_smote(spark, sf_dir).groupBy("synthetic").agg(F.count(F.lit(1)).alias("n"))


@register(
    "d7_stratified_split",
    with_(TX, FEAT, GRAPH)
    + """, c AS (SELECT is_fraud, count(*) AS nc FROM lb GROUP BY is_fraud),
r AS (SELECT lb.account, lb.is_fraud, row_number() OVER (PARTITION BY lb.is_fraud ORDER BY md5(lb.account || '|42'), lb.account) AS rn FROM lb)
SELECT r.account, r.is_fraud, CASE WHEN rn <= round(CAST(0.15 AS DOUBLE) * nc) THEN 'val' ELSE 'train' END AS fold FROM r JOIN c USING (is_fraud)""",
)
def d7_stratified_split(spark, sf_dir):
    return D.stratified_split(E.account_labels(_tx(spark, sf_dir)))


#: Log odds of the label that the model queries learn, over scaled features. The fixture's own label follows
#: from the features, so a model could not fail on it; this one is drawn by a seeded hash of the row's id.
LABEL_ODDS = {"amount_log": 0.9, "hour_of_day": 0.6, "type_encoded": -0.5, "orig_tx_count": 0.4}
LABEL_BASE, FRAUD_ODDS = -4.0, 2.0


def _noisy(df: DataFrame) -> DataFrame:
    odds = F.lit(LABEL_BASE) + F.lit(FRAUD_ODDS) * F.col("isFraud")
    for name, weight in LABEL_ODDS.items():
        odds = odds + F.lit(weight) * F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col(name)))
    u = F.pmod(F.xxhash64("tx_id", F.lit(5)), F.lit(100_000)) / F.lit(100_000.0)
    return df.withColumn("isFraud", (u < F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).cast("int"))


def _noisy_frames(spark, sf_dir):
    return tuple(map(_noisy, _model_frames(spark, sf_dir)))


@register("f1_train_gbt_a")
def f1_train_gbt_a(spark, sf_dir):
    train, val, test = _noisy_frames(spark, sf_dir)
    return M.predict_proba(M.train_gbt_a(train, val), test, "p_xgb").select("tx_id", "isFraud", "p_xgb")


@register("f2_train_gbt_b")
def f2_train_gbt_b(spark, sf_dir):
    train, val, test = _noisy_frames(spark, sf_dir)
    return M.predict_proba(M.train_gbt_b(train, val), test, "p_lgb").select("tx_id", "isFraud", "p_lgb")


@register("f3_early_stopping")
def f3_early_stopping(spark, sf_dir):
    """Trees kept, rounds seen and the precision of the validation fold beside its share of positives."""
    train, val, _t = _noisy_frames(spark, sf_dir)
    base = val.agg(F.avg("isFraud")).first()[0]
    rows = [(n, m.best, m.rounds, max(m.precision), base) for n, m in zip(("gbt_a", "gbt_b"), M.boost_both(train, val))]
    return spark.createDataFrame(rows, "model string, trees int, rounds int, auprc double, prevalence double")


def _stub_probas(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return tx.select(
        "tx_id", "isFraud",
        F.col("score_stub").alias("p_xgb"),
        (F.pmod(F.col("tx_id") * 7, F.lit(100)) / F.lit(100.0)).alias("p_lgb"),
        F.when(F.pmod(F.col("tx_id"), F.lit(3)) == 0, F.lit(None).cast("double")).otherwise(F.col("step") / F.lit(720.0)).alias("p_gnn"),
    )


@register(
    "f4_blend",
    with_(TX)
    + """, p AS (SELECT tx_id, isFraud, score_stub AS p_xgb, ((tx_id * 7) % 100) / CAST(100 AS DOUBLE) AS p_lgb,
  CASE WHEN tx_id % 3 = 0 THEN NULL ELSE step / CAST(720 AS DOUBLE) END AS p_gnn FROM tx)
SELECT tx_id, isFraud, round(p_xgb, 6) AS p_xgb, round(p_lgb, 6) AS p_lgb, round(p_gnn, 6) AS p_gnn,
  round(CASE WHEN p_gnn IS NULL THEN (CAST(0.35 AS DOUBLE) * p_xgb + CAST(0.35 AS DOUBLE) * p_lgb) / (CAST(0.35 AS DOUBLE) + CAST(0.35 AS DOUBLE))
    ELSE (CAST(0.35 AS DOUBLE) * p_xgb + CAST(0.35 AS DOUBLE) * p_lgb + CAST(0.3 AS DOUBLE) * p_gnn)
       / (CAST(0.35 AS DOUBLE) + CAST(0.35 AS DOUBLE) + CAST(0.3 AS DOUBLE)) END, 6) AS ml_proba FROM p""",
)
def f4_blend(spark, sf_dir):
    return M.blend(_stub_probas(spark, sf_dir))


@register("f5_fit_stacker")
def f5_fit_stacker(spark, sf_dir):
    """A stacker on the scores of both tree models (10 rounds each) and of the graph model, fitted on the
    validation split, which none of them was fitted on, and applied to the test split."""
    train, val, test = _noisy_frames(spark, sf_dir)
    a, b = (m.model for m in M.boost_both(train, rounds=10))
    nodes, edges = _degree_nodes(_split(spark, sf_dir).where("split = 'train'").drop("split"))
    graph = EN.NodeClassifier(inputCols=_DEGREE_COLS + _AA_COLS, hops=2).on_edges(edges).fit(nodes).transform(nodes)
    scores = checkpointed(graph.select("account", F.col("gnn_proba").alias("p_gnn")))

    def scored(rows):
        both = M.predict_proba(b, M.predict_proba(a, rows, "p_xgb"), "p_lgb")
        return both.join(scores.withColumnRenamed("account", "nameOrig"), "nameOrig", "left")

    model = M.fit_stacker(scored(val).na.fill(0.0, ["p_gnn"]))
    return M.apply_stacker(model, scored(test)).select("tx_id", "isFraud", "ml_proba")


@register("f8_feature_importance")
def f8_feature_importance(spark, sf_dir):
    train, val, _t = _noisy_frames(spark, sf_dir)
    return M.feature_importance(spark, M.train_gbt_a(train, val), name="gbt_a")


def _nodes_and_edges(spark, sf_dir):
    """Node features and edges: PageRank to its tolerance, betweenness from at most ``BETWEENNESS_PIVOTS`` nodes."""
    feat = _feat(spark, sf_dir)
    nf = checkpointed(_node_features(feat))
    return nf, [c for c in nf.columns if c not in ("account", "is_fraud")], E.edges(feat).persist()


def _node_scores(spark, sf_dir, method="sage"):
    nf, cols, ed = _nodes_and_edges(spark, sf_dir)
    return EN.node_scores(ed, nf, cols, method, hops=3)


@register("f9_fit_ensemble")
def f9_fit_ensemble(spark, sf_dir):
    """Both tree models and the stacker on E20's node scores joined by account."""
    scores = checkpointed(_node_scores(spark, sf_dir).select("account", "gnn_proba"))
    train, val, test = (E.join_node_scores(d, scores).drop("split", "nameOrig") for d in _noisy_frames(spark, sf_dir))
    ens = M.fit_ensemble(train, val, gnn="gnn_proba")
    scored = ens.score(test, gnn="gnn_proba").select(F.col("isFraud").alias("label"), F.col("ml_proba").alias("score"))
    return G.evaluate(checkpointed(scored), 0.5, "Test")  # each measure passes the rows; they are scored once


@register(
    "a4_write_read_splits",
    with_(TX, FEAT, SPLIT) + "SELECT tx_id, step, isFraud FROM sp WHERE split = 'test'",
)
def a4_write_read_splits(spark, sf_dir):
    sp = _split(spark, sf_dir).select("tx_id", "step", "isFraud", "split")
    path = scratch_path(spark, "splits")
    A.write_table(sp, path, ["split"])
    return A.read_table(spark, path, "test").select("tx_id", "step", "isFraud")


@register("a3_write_read_features", with_(TX, FEAT) + "SELECT tx_id, round(amount_log, 6) AS amount_log, orig_tx_count, orig_unique_dests FROM feat")
def a3_write_read_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    A.write_features(_feat(spark, sf_dir), path)
    return A.read_table(spark, path).select("tx_id", "amount_log", "orig_tx_count", "orig_unique_dests")


@register(
    "a4_splits_with_scaler",
    with_(TX, FEAT, SPLIT)
    + """SELECT split, count(*) AS n, sum(isFraud)::BIGINT AS fraud, (SELECT round(avg(amount), 6) FROM sp WHERE split = 'train') AS train_mean
FROM sp WHERE split = 'val' GROUP BY split""",
)
def a4_splits_with_scaler(spark, sf_dir):
    """Splits and the scaler fitted on train, written and read back together."""
    sp = _split(spark, sf_dir)
    params = D.fit_scaler(C.feature_matrix(sp.where(F.col("split") == "train")))
    path = scratch_path(spark, "splits-scaler")
    A.write_splits(sp.select("tx_id", "isFraud", "split"), params, path)
    rows, scaler = A.read_splits(spark, path, "val")
    mean = scaler.where(F.col("feature") == "amount").select(F.col("mean").alias("train_mean"))
    found = rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("isFraud").cast("long").alias("fraud"))
    one = F.lit(1).alias("_k")
    return found.select("*", one).join(mean.select("*", one), "_k").drop("_k")


@register(
    "a5_write_read_graph",
    with_(TX, FEAT, GRAPH)
    + """SELECT nd.account, coalesce(o.c, 0) AS out_edges, coalesce(o.w, 0) AS out_amount, lb.is_fraud FROM nd JOIN lb USING (account)
LEFT JOIN (SELECT src AS account, count(*) AS c, sum(amount) AS w FROM ed GROUP BY src) o USING (account)""",
)
def a5_write_read_graph(spark, sf_dir):
    feat, nd, ed = _graph(spark, sf_dir)
    path = scratch_path(spark, "graph")
    A.write_graph(nd, ed, E.account_labels(feat, nd), path)
    nodes, edges, labels = A.read_graph(spark, path)
    out = edges.groupBy(F.col("src").alias("account")).agg(F.count("*").alias("out_edges"), F.sum("amount").alias("out_amount"))
    return nodes.select("account").join(labels, "account").join(out, "account", "left").select(
        "account", F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("out_amount", F.lit(0.0)).alias("out_amount"), "is_fraud"
    )


@register("a6_save_load_ensemble")
def a6_save_load_ensemble(spark, sf_dir):
    """Scores of the saved and loaded ensemble beside those before."""
    train, val, test = (d.drop("split", "nameOrig") for d in _noisy_frames(spark, sf_dir))
    ens = M.fit_ensemble(train, val, use_smote=False)
    ens.scaler = D.fit_scaler(C.feature_matrix(_split(spark, sf_dir), keep=["split"]).where(F.col("split") == "train"))
    path = scratch_path(spark, "ensemble")
    ens.save(path)
    before = ens.score(test, output="before").select("tx_id", "before")
    return before.join(M.Ensemble.load(spark, path).score(test, output="after").select("tx_id", "after"), "tx_id")


@register(
    "a7_metrics_report",
    with_(TX)
    + """, s AS (SELECT isFraud AS label, score_stub AS score FROM tx WHERE step > 672),
c AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM s GROUP BY score),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS ap, sum(neg * (2 * tp - pos)) / (2 * sum(pos) * sum(neg)) AS auc FROM k),
m AS (SELECT sum((score >= 0.5 AND label = 1)::INT)::BIGINT AS tp, sum((score >= 0.5 AND label = 0)::INT)::BIGINT AS fp,
  sum((score < 0.5 AND label = 1)::INT)::BIGINT AS fn, sum((score < 0.5 AND label = 0)::INT)::BIGINT AS tn FROM s)
SELECT round(ap, 4) AS auprc, round(auc, 4) AS auc_roc,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 4) AS f1,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS "precision", tn, fp, fn, tp,
  (SELECT round(avg(amount), 6) FROM tx) AS mean_amount FROM r, m""",
)
def a7_metrics_report(spark, sf_dir):
    """The report with an importance map, written as JSON and read back. The map
    holds a number that SQL can check (a column's mean), not a model's."""
    s = _scored(spark, sf_dir).where(F.col("step") > 672)
    named = _tx(spark, sf_dir).agg(F.avg("amount").alias("importance")).select(
        F.lit("xgb").alias("model"), F.lit("amount").alias("feature"), "importance"
    )
    path = scratch_path(spark, "report")
    A.write_metrics_report(A.metrics_report(G.evaluate(s, 0.5, "Test"), named), path)
    back = A.read_metrics_report(spark, path)
    return back.select("metrics.*", F.col("feature_importance")["xgb"]["amount"].alias("mean_amount"))


@register("a10_requests_from_json", with_(TX) + "SELECT step, type, amount, nameOrig, nameDest FROM tx WHERE step >= 0")
def a10_requests_from_json(spark, sf_dir):
    """Request bodies of many transactions each, parsed back into rows."""
    tx = _tx(spark, sf_dir).select([f.name for f in STREAM_SCHEMA.fields if f.name in TX_COLUMNS])
    bodies = tx.groupBy(F.pmod(F.xxhash64("nameOrig", "step"), F.lit(64))).agg(
        F.to_json(F.struct(F.collect_list(F.struct(*tx.columns)).alias("transactions"))).alias("value")
    )
    rows = A.validate_rows(A.requests_from_json(spark, bodies))
    return rows.where("step >= 0").select("step", "type", "amount", "nameOrig", "nameDest")


# ------------------------------------------------------------------ I (streaming)
from txrisk.streaming import stream as S  # noqa: E402
from txrisk.streaming.runner import run_to_sink, run_to_table  # noqa: E402
from txrisk.streaming.sinks import BatchSinks  # noqa: E402


def _stream_src(spark, sf_dir):
    return _tx(spark, sf_dir).select(*TX_COLUMNS, "score_stub")


_COUNTER_SCHEMA = (
    "total long, valid long, rejected long, bad_step long, bad_amount long, bad_type long, bad_nameOrig long, "
    "bad_nameDest long, fraud_count long, amount double"
)
_HISTORY_SQL = QUERIES["h1_history_features"][1]
_ALERTS_SQL = with_(TX, RULE) + """SELECT tx_id, round(rule_score, 6) AS rule_score, fraud_proba, is_fraud, risk_level, alert_reason FROM al"""


@register("i1_stream_rule_alerts", _ALERTS_SQL)
def i1_stream_rule_alerts(spark, sf_dir):
    out = run_to_table(spark, _stream_src(spark, sf_dir), lambda s: S.stream_rule_alerts(s, "score_stub"))
    return out.select("tx_id", "rule_score", "fraud_proba", "is_fraud", "risk_level", "alert_reason")


@register("i2_stream_history_features", _HISTORY_SQL)
def i2_stream_history_features(spark, sf_dir):
    return run_to_table(spark, _stream_src(spark, sf_dir), lambda s: S.stream_history_features(s), timers=True)


#: Of the replay with late rows: every how many-th row is late, and by how many steps; far behind the watermark.
LATE_EVERY, LATE_BY = 20, 60


@register(
    "i3_late_rows",
    with_(TX)
    + f""", t AS (SELECT *, step + CASE WHEN tx_id % {LATE_EVERY} = 0 THEN {LATE_BY} ELSE 0 END AS arrival FROM tx),
l AS (SELECT min(arrival) AS lo, greatest(1, ceil((max(arrival) - min(arrival) + 1) / 8.0)) AS width FROM t),
b AS (SELECT tx_id, nameOrig, nameDest, step, amount, floor((arrival - lo) / width) AS b FROM t, l),
o AS (SELECT nameOrig, b, max(max(step)) OVER (PARTITION BY nameOrig ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM b GROUP BY nameOrig, b),
r AS (SELECT b.*, o.top FROM b JOIN o ON o.b = b.b AND o.nameOrig IS NOT DISTINCT FROM b.nameOrig)
SELECT r.tx_id, count(q.tx_id) + 1 AS orig_tx_count, round(coalesce(sum(q.amount), 0) + r.amount, 6) AS orig_total_sent,
  CASE WHEN count(q.tx_id) > 0 THEN count(DISTINCT q.nameDest) ELSE 1 END AS orig_unique_dests
FROM r LEFT JOIN b q ON q.nameOrig IS NOT DISTINCT FROM r.nameOrig AND q.step >= r.step - 24
  AND ((q.b = r.b AND (q.step < r.step OR (q.step = r.step AND q.tx_id < r.tx_id))) OR (q.b < r.b AND q.step >= r.top - 24))
GROUP BY r.tx_id, r.amount""",
)
def i3_late_rows(spark, sf_dir):
    """History of a stream in which some rows arrive long after the watermark has passed
    them: each is scored by what its account's state holds of its window."""
    late = F.when(F.col("tx_id") % LATE_EVERY == 0, F.lit(LATE_BY)).otherwise(F.lit(0))
    src = _stream_src(spark, sf_dir).withColumn("arrival", F.col("step") + late)
    return run_to_table(spark, src, lambda s: S.stream_history_features(s), by="arrival", timers=True)


@register("i4_stream_alert_stats", QUERIES["h9_alert_stats"][1])
def i4_stream_alert_stats(spark, sf_dir):
    return run_to_table(
        spark, _stream_src(spark, sf_dir),
        lambda s: S.stream_alert_stats(S.stream_rule_alerts(s, "score_stub")), mode="complete",
    )


@register("i4_observed_counters", with_(TX, REQ) + f"SELECT {_COUNTED} FROM rv")
def i4_observed_counters(spark, sf_dir):
    """Running totals of a stream taken from its progress: what each batch counted
    while its valid and quarantined rows went to their sinks, summed up."""
    sinks = BatchSinks(scratch_path(spark, "validated"), {"valid": lambda b: b.where("valid"), "refused": lambda b: b.where("NOT valid")})
    src = _requests(spark, sf_dir).withColumn("arrival", F.col("tx_id"))
    batches = run_to_sink(spark, src, lambda s: A.counted(A.validate_rows(s)), sinks, chunks=3, by="arrival")
    counters = [b[A.REQUESTS] for b in batches if A.REQUESTS in b]  # a row of counters a batch
    seen = spark.createDataFrame(counters, schema=_COUNTER_SCHEMA)
    return seen.agg(*[F.sum(c).alias(c) for c in seen.columns])


@register("a9_alert_sinks", _ALERTS_SQL + " WHERE is_fraud")
def a9_alert_sinks(spark, sf_dir):
    """The alerts read back from sinks to which every batch was handed twice."""
    sinks = BatchSinks(scratch_path(spark, "alert-sinks"), {"alerts": lambda b: b.where("is_fraud"), "stats": H.alert_stats})

    def twice(batch, number):
        sinks(batch, number)
        sinks(batch, number)

    run_to_sink(spark, _stream_src(spark, sf_dir), lambda s: S.stream_rule_alerts(s, "score_stub"), twice)
    return sinks.read(spark, "alerts").select("tx_id", "rule_score", "fraud_proba", "is_fraud", "risk_level", "alert_reason")


@register(
    "i5_stream_window_graph",
    with_(TX)
    + """, w AS (SELECT unnest(range(step - 24, step + 1))::INT AS window_step, nameOrig AS src, nameDest AS dst, step, tx_id, amount FROM tx),
e AS (SELECT window_step, src, dst, arg_max(amount, (step, tx_id)) AS amount FROM w GROUP BY ALL),
b AS (SELECT window_step, src AS account, amount, 1 AS o FROM e UNION ALL SELECT window_step, dst, amount, 0 FROM e)
SELECT window_step, account, count(*) FILTER (WHERE o = 0) AS in_degree, count(*) FILTER (WHERE o = 1) AS out_degree,
  coalesce(sum(amount) FILTER (WHERE o = 0), 0)::DOUBLE AS amount_in, coalesce(sum(amount) FILTER (WHERE o = 1), 0)::DOUBLE AS amount_out
FROM b WHERE account IS NOT NULL GROUP BY ALL""",
)
def i5_stream_window_graph(spark, sf_dir):
    panes = run_to_table(spark, _stream_src(spark, sf_dir), S.stream_panes, mode="update", keys=S.PANE_KEYS)
    return S.window_graph(panes)


def _live_models(spark, sf_dir):
    train, val, _test = _noisy_frames(spark, sf_dir)
    ens = M.fit_ensemble(train.drop("split", "nameOrig"), val.drop("split", "nameOrig"), use_smote=False)
    fm = C.feature_matrix(_split(spark, sf_dir), keep=["split"])
    src = _tx(spark, sf_dir).select(*[c for c in TX_COLUMNS if c not in ("isFraud", "isFlaggedFraud")])
    return src, ens, D.fit_scaler(fm.where(F.col("split") == "train"))


@register("h8_score_end_to_end")
def h8_score_end_to_end(spark, sf_dir):
    """Live features, scaler, models, blend and alerts as one batch job."""
    src, ens, params = _live_models(spark, sf_dir)
    return H.score_end_to_end(src, ens, params)


@register("i6_stream_score")
def i6_stream_score(spark, sf_dir):
    src, ens, params = _live_models(spark, sf_dir)
    return run_to_table(spark, src, lambda s: S.stream_score(s, ens, params), timers=True)


def _h2_sql() -> str:
    fcols = []
    for c in FEATURE_COLS:
        src = {
            "amount_zscore": "CAST(0 AS DOUBLE)",
            "type_encoded": "CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3 WHEN 'TRANSFER' THEN 4 ELSE 0 END",
        }.get(c, c)
        fcols.append(f"round(coalesce(CAST(CAST({src} AS FLOAT) AS DOUBLE), 0), 6) AS {c}")
    return (
        with_(TX, FEAT)
        + """, h AS (SELECT a.tx_id, count(b.tx_id) AS n, sum(b.amount) AS s, count(DISTINCT b.nameDest) AS d
  FROM tx a LEFT JOIN tx b ON a.nameOrig = b.nameOrig AND ((b.step >= a.step - 24 AND b.step < a.step) OR (b.step = a.step AND b.tx_id < a.tx_id))
  GROUP BY a.tx_id),
lv AS (SELECT f.tx_id, f.type, f.amount, f.amount_log, f.is_round_amount, f.oldbalanceOrg, f.newbalanceOrig, f.oldbalanceDest,
  f.newbalanceDest, f.balance_diff_orig, f.balance_diff_dest, f.balance_ratio_orig, f.balance_ratio_dest, f.orig_balance_error,
  f.dest_balance_error, f.has_orig_error, f.has_dest_error, f.orig_zero_before, f.orig_zero_after, f.dest_zero_before,
  f.hour_of_day, f.day_of_week, f.step_mod_24, h.n + 1 AS orig_tx_count, coalesce(h.s, 0) + f.amount AS orig_total_sent,
  CASE WHEN h.n > 0 THEN h.d ELSE 1 END AS orig_unique_dests FROM feat f JOIN h USING (tx_id))
SELECT tx_id, """
        + ", ".join(fcols)
        + " FROM lv"
    )


@register("h2_live_features", _h2_sql())
def h2_live_features(spark, sf_dir):
    return H.live_features(_tx(spark, sf_dir))
