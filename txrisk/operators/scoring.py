"""H: batch scoring: live history features, rules, blend, risk, reasons, stats.

History features (H1) work on (origin, step) totals and (origin, destination,
step) occurrences, so no window holds more than one origin's distinct steps or
a range of ids of one of its steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions import columns as X
from txrisk.sources.schema import FEATURE_COLS

# --- fixed values: scoring defaults ---
HISTORY_WINDOW = 24
RANGE_IDS = 100_000  # ids of one (origin, step) that a window takes together
ALERT_THRESHOLD = 0.70
RECENT_ALERTS = 20
ACCOUNT_DISPLAY_CHARS = 12
HIGH_LEVELS = ("HIGH", "CRITICAL")


def live_features(tx: DataFrame, window: int = HISTORY_WINDOW, keep: list[str] | None = None) -> DataFrame:
    """H2: the 26 model columns as computed at scoring time: z-score fixed 0,
    the fixed type code map, history aggregates from H1; single precision
    like the serving path, NaN/null -> 0. Apply ``prep.apply_scaler`` next."""
    keep = keep or ["tx_id"]
    hist = history_features(tx, window, keep=tx.columns)
    j = hist.select(
        "*", *X.row_features(), F.lit(0.0).alias("amount_zscore"), X.type_code().alias("type_encoded")
    )
    single = [
        F.nanvl(F.coalesce(F.col(c).cast("float").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
        for c in FEATURE_COLS
    ]
    overlap = [c for c in keep if c in FEATURE_COLS]
    if overlap:
        raise ValueError(f"columns of the model cannot be kept beside it: {overlap}")
    return j.select(*keep, *single)


def score_batch(df: DataFrame, proba: str = "ml_proba", threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """H8 (H3-H7): rule score, blend, alert decision, risk level and reason.

    ``proba`` is the model probability column (F4's blend, or any score).
    Output: the transaction columns plus rule_score, fraud_proba (rounded to
    4), is_fraud, risk_level, alert_reason. Decision, level and reason use the
    unrounded blend."""
    rule = X.rule_score()
    scored = df.withColumn("rule_score", rule)
    blended = X.blend_rule(F.col(proba), F.col("rule_score"))
    scored = scored.withColumn("_p", blended)
    out = scored.select(
        *[c for c in df.columns if c != proba],
        "rule_score",
        F.round("_p", 4).alias("fraud_proba"),
        (F.col("_p") >= F.lit(threshold)).alias("is_fraud"),
        X.risk_level(F.col("_p")).alias("risk_level"),
        X.alert_reason(F.col("_p"), F.col("rule_score")).alias("alert_reason"),
    )
    return out


def score_live(hist: DataFrame, raw_cols: list[str], ensemble, scaler_params: DataFrame,
               threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Rows with their history features -> the 26 live features -> scaler ->
    ensemble -> alerts (H2, D3, F4, H3-H7). Works on a table or a stream: no
    shuffle, no join with the rows themselves."""
    from txrisk.operators.prep import apply_scaler

    feats = hist.select(
        "*", *X.row_features(), F.lit(0.0).alias("amount_zscore"), X.type_code().alias("type_encoded")
    )
    single = [
        F.nanvl(F.coalesce(F.col(c).cast("float").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURE_COLS
    ]
    # a raw column that is also a model column is kept aside under another name
    aside = {c: f"_raw_{c}" if c in FEATURE_COLS else c for c in raw_cols}
    live = feats.select(*[F.col(c).alias(a) for c, a in aside.items()], *single)
    scored = ensemble.score(apply_scaler(live, scaler_params, keep=list(aside.values())))
    restored = scored.select(*[F.col(a).alias(c) for c, a in aside.items()], "ml_proba")
    return score_batch(restored, "ml_proba", threshold)


def score_end_to_end(tx: DataFrame, ensemble, scaler_params: DataFrame, threshold: float = ALERT_THRESHOLD,
                     window: int = HISTORY_WINDOW) -> DataFrame:
    """H8 whole, as one batch plan from raw transactions to alerts."""
    hist = history_features(tx, window, keep=tx.columns)
    return score_live(hist, tx.columns, ensemble, scaler_params, threshold)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """H9: total scored, alerts, alert rate = alerts / max(total, 1)."""
    a = alerts.agg(
        F.count(F.lit(1)).alias("total_scored"),
        F.sum(F.when(F.col("is_fraud"), 1).otherwise(0)).cast("long").alias("total_alerts"),
    )
    return a.withColumn(
        "alert_rate", F.col("total_alerts") / F.greatest(F.col("total_scored"), F.lit(1)).cast("double")
    )


def recent_alerts(alerts: DataFrame, threshold: float = ALERT_THRESHOLD, n: int = RECENT_ALERTS) -> DataFrame:
    """The newest ``n`` alerts at or above the threshold (top-k, not a sort
    of the whole table), account cut to 12 characters."""
    flagged = alerts.where(F.col("fraud_proba") >= F.lit(threshold))
    return flagged.orderBy(F.desc("step"), F.desc("tx_id")).limit(n).select(
        "tx_id", "step",
        F.substring("nameOrig", 1, ACCOUNT_DISPLAY_CHARS).alias("account"),
        "amount", "type", "fraud_proba", "risk_level",
    )


def alert_counts(alerts: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """H10 counters: processed, flagged (>= threshold), high (HIGH or CRITICAL among flagged)."""
    flagged = F.col("fraud_proba") >= F.lit(threshold)
    return alerts.agg(
        F.count(F.lit(1)).alias("processed"),
        F.sum(F.when(flagged, 1).otherwise(0)).cast("long").alias("flagged"),
        F.sum(F.when(flagged & F.col("risk_level").isin(*HIGH_LEVELS), 1).otherwise(0)).cast("long").alias("high"),
    )


def history_features(tx: DataFrame, window: int = HISTORY_WINDOW, keep: list[str] | None = None) -> DataFrame:
    """H1: per row, over earlier-arrived rows of the same origin within the
    last ``window`` steps: count + 1 (orig_tx_count), amount sum + own amount
    (orig_total_sent), and distinct destinations of the history only (1 when
    the history is empty; orig_unique_dests). Rows come with their ``keep``
    columns (default tx_id), so nothing is joined back to the source.

    No window holds more than one origin's *distinct steps*, or the rows of one
    of its steps with ids of one range, and no per-row set is built:

    * previous-step count / sum: per (origin, step) totals, then a RANGE
      frame over that origin's steps;
    * previous-step distinct destinations: each distinct (origin, dest, step)
      occurrence u covers the later steps s with u < s <= min(u + window,
      next occurrence step); the coverage intervals become +1/-1 events summed
      per (origin, step) and accumulated over the origin's steps;
    * same-step part: running counts over (tx_id) inside (origin, step), the
      distinct part counting only destinations not already seen in the
      previous ``window`` steps, at their first arrival in the step."""
    keep = keep or ["tx_id"]
    source = tx.select("tx_id", "step", "nameOrig", "nameDest", "amount", F.struct(*keep).alias("_x"))
    base = source.drop("_x")
    o, d, s = F.col("nameOrig"), F.col("nameDest"), F.col("step")
    per_step = base.groupBy("nameOrig", "step").agg(
        F.count("tx_id").alias("_n"), F.sum("amount").alias("_s")
    )
    w_prev = Window.partitionBy("nameOrig").orderBy("step").rangeBetween(-window, -1)
    prev = per_step.select(
        "nameOrig", "step",
        F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_np"),
        F.sum("_s").over(w_prev).alias("_sp"),
    )
    trip = base.where(d.isNotNull()).groupBy("nameOrig", "nameDest", "step").agg(F.min("tx_id").alias("_first"))
    w_pair = Window.partitionBy("nameOrig", "nameDest").orderBy("step")
    trip = trip.select(
        "nameOrig", "nameDest", "step", "_first",
        F.lead("step").over(w_pair).alias("_next"), F.lag("step").over(w_pair).alias("_prev"),
    )
    end = F.least(s + window, F.coalesce(F.col("_next"), s + window))
    events = trip.select(o, (s + 1).alias("step"), F.lit(1).alias("_e")).unionAll(
        trip.select(o, (end + 1).alias("step"), F.lit(-1).alias("_e"))
    ).unionAll(per_step.select(o, s, F.lit(0).alias("_e")))
    w_cum = Window.partitionBy("nameOrig").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    covered = (
        events.groupBy("nameOrig", "step").agg(F.sum("_e").alias("_e"))
        .select("nameOrig", "step", F.sum("_e").over(w_cum).alias("_dp"))
    )
    is_new = (F.col("_prev").isNull() | (F.col("_prev") < s - window)).cast("long")
    firsts = trip.select(o, s, F.col("_first").alias("_t"), F.lit(1).alias("_kind"), is_new.alias("_inc"),
                         F.lit(0).alias("_row"), F.lit(0.0).alias("_amt"), F.lit(None).cast(source.schema["_x"].dataType).alias("_x"),
                         F.lit(None).cast("double").alias("amount"))
    rows = source.select(o, s, F.col("tx_id").alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_inc"),
                       F.lit(1).alias("_row"), F.col("amount").alias("_amt"), "_x", "amount")
    # inside (origin, step): running sums within a range of ids, plus the ranges before
    both = firsts.unionByName(rows).withColumn("_r", F.floor(F.col("_t") / RANGE_IDS))
    amount = F.when(F.col("_row") == 1, F.col("_amt"))
    w_same = Window.partitionBy("nameOrig", "step", "_r").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    same = both.select(
        "nameOrig", "step", "_r", "_x", "amount", "_kind",
        F.coalesce(F.sum("_inc").over(w_same), F.lit(0)).alias("_ds"),
        F.coalesce(F.sum("_row").over(w_same), F.lit(0)).alias("_ns"),
        F.sum(amount).over(w_same).alias("_ss"),
    ).where(F.col("_kind") == 0)
    w_before = Window.partitionBy("nameOrig", "step").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy("nameOrig", "step", "_r").agg(
        F.sum("_inc").alias("_i"), F.sum("_row").alias("_n"), F.sum(amount).alias("_s")
    ).select(
        "nameOrig", "step", "_r",
        F.coalesce(F.sum("_i").over(w_before), F.lit(0)).alias("_bd"),
        F.coalesce(F.sum("_n").over(w_before), F.lit(0)).alias("_bn"),
        F.sum("_s").over(w_before).alias("_bs"),
    )
    before = ranges.join(prev, ["nameOrig", "step"], "left").join(covered, ["nameOrig", "step"], "left")
    j = same.join(before, ["nameOrig", "step", "_r"], "left").withColumns(
        {
            "_ns": F.col("_ns") + F.coalesce("_bn", F.lit(0)),
            "_ds": F.col("_ds") + F.coalesce("_bd", F.lit(0)),
            "_ss": F.coalesce("_ss", F.lit(0.0)) + F.coalesce("_bs", F.lit(0.0)),
        }
    )
    n_hist = F.coalesce(F.col("_np"), F.lit(0)) + F.col("_ns")
    return j.select(
        "_x.*",
        (n_hist + 1).cast("long").alias("orig_tx_count"),
        (F.coalesce(F.col("_sp"), F.lit(0.0)) + F.coalesce(F.col("_ss"), F.lit(0.0)) + F.col("amount")).alias("orig_total_sent"),
        F.when(n_hist > 0, F.coalesce(F.col("_dp"), F.lit(0)) + F.col("_ds")).otherwise(F.lit(1)).cast("long").alias("orig_unique_dests"),
    )
