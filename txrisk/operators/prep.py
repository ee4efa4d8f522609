"""D: time split, scaling, class weights, rebalancing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.distributed import checked_broadcast, running_totals
from txrisk.sources.schema import FEATURE_COLS, TRAIN_MAX_STEP, VAL_MAX_STEP

# --- fixed values: class weighting and sampling defaults ---
FIXED_POSITIVE_WEIGHT = 100.0
POS_WEIGHT_EPS = 1e-9
VAL_FRACTION = 0.15
SEED = 42


def temporal_split(df: DataFrame, train_max: int = TRAIN_MAX_STEP, val_max: int = VAL_MAX_STEP) -> DataFrame:
    """split = train (step <= train_max), val (<= val_max), test (above).

    A null step belongs to no split (null), as comparisons with NaN are false.
    Write with ``partitionBy("split")`` so reading one split prunes the rest."""
    s = F.col("step")
    return df.withColumn(
        "split",
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s <= train_max, F.lit("train"))
        .when(s <= val_max, F.lit("val"))
        .otherwise(F.lit("test")),
    )


def fit_scaler(train: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column mean and population std (zero std -> scale 1).

    One aggregate over the (already filled) columns, stacked to one row per
    feature: (feature, idx, mean, scale)."""
    cols = cols or FEATURE_COLS
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    one = train.agg(*aggs)
    pairs = ", ".join(f"'{c}', {i}, `m_{c}`, `s_{c}`" for i, c in enumerate(cols))
    long = one.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, idx, mean, std)")
    return long.select(
        "feature",
        F.col("idx").cast("int").alias("idx"),
        F.coalesce(F.col("mean"), F.lit(0.0)).alias("mean"),
        F.when(F.col("std").isNull() | (F.col("std") == 0), F.lit(1.0)).otherwise(F.col("std")).alias("scale"),
    )


def apply_scaler(df: DataFrame, params: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """D3: (x - mean) / scale with the fitted parameters as literals.

    The parameter table has one row per feature (bounded by the schema), so it
    is collected once and folded into the projection: no join at all."""
    rows = params.orderBy("idx").collect()
    keep = keep or [c for c in df.columns if c not in {r["feature"] for r in rows}]
    scaled = [((F.col(r["feature"]) - F.lit(r["mean"])) / F.lit(r["scale"])).alias(r["feature"]) for r in rows]
    return df.select(*keep, *scaled)


def pos_weight(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """n_neg / (n_pos + 1e-9)."""
    return df.agg(
        (F.sum(F.when(F.col(label) == 0, 1).otherwise(0)) / (F.sum(F.when(F.col(label) == 1, 1).otherwise(0)) + F.lit(POS_WEIGHT_EPS))).alias("pos_weight")
    )


def class_weights(df: DataFrame, mode: str = "fixed", label: str = "isFraud", output: str = "weight") -> DataFrame:
    """Weight column. ``fixed``: positives 100, negatives 1. ``balanced``:
    n / (2 * n_class) per class (class counts: a two-row table, broadcast)."""
    if mode == "fixed":
        return df.withColumn(
            output, F.when(F.col(label) == 1, F.lit(FIXED_POSITIVE_WEIGHT)).otherwise(F.lit(1.0))
        )
    if mode != "balanced":
        raise ValueError(f"unknown class weight mode: {mode}")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(label).alias("_k"))
    w = counts.withColumn("_j", F.lit(1)).join(total.withColumn("_j", F.lit(1)), "_j").select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(output)
    )
    return df.join(checked_broadcast(w, 1000), label, "left")


def _hash_key(cols: list[str], seed: int) -> F.Column:
    """Deterministic pseudo-random order key, reproducible in SQL engines (md5)."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def stratified_split(
    nodes: DataFrame, label: str = "is_fraud", key: str = "account", fraction: float = VAL_FRACTION, seed: int = SEED
) -> DataFrame:
    """Per class, the round(fraction * n_class) rows with the smallest hash
    go to ``val``, the rest to ``train`` (exact counts, stratified, seeded).

    Ranks come from the distributed running count (range partitions on
    (label, hash)): no single-partition window over a whole class."""
    h = nodes.withColumn("_h", _hash_key([key], seed)).withColumn("_one", F.lit(1.0))
    ranked = running_totals(h, [("_h", True), (key, True)], ["_one"], [label])
    counts = nodes.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    j = ranked.join(checked_broadcast(counts, 1000), label, "left")
    is_val = F.col("cum__one") <= F.round(F.col("_nc") * F.lit(fraction))
    return j.select(*nodes.columns, F.when(is_val, F.lit("val")).otherwise(F.lit("train")).alias("fold"))
