"""C: feature engineering over the transaction table.

``engineer_features`` adds 21 columns to the raw table. Row-local columns are
plain expressions; the three fitted pieces are small aggregate tables joined
back:

* per-type amount mean / sample std (z-score): one row per type, broadcast
  after a size check;
* the alphabetical type index: one row per type, broadcast after a size check;
* per-origin count / sum / distinct destinations: a two-level aggregation
  ((origin, destination) then origin, both map-side combined), joined back on
  ``nameOrig`` (shuffle join; AQE splits a hub origin's partition).

``fit`` lets the stats be fitted on a subset (e.g. the train split) and applied
to all rows; the default fits on the input itself, like the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions import columns as X
from txrisk.functions.distributed import checked_broadcast
from txrisk.sources.schema import FEATURE_COLS

ZSCORE_EPS = 1e-9

ENGINEERED_COLS = [
    "amount_log", "amount_zscore", "is_round_amount",
    "balance_diff_orig", "balance_diff_dest", "balance_ratio_orig", "balance_ratio_dest",
    "orig_balance_error", "dest_balance_error", "has_orig_error", "has_dest_error",
    "orig_zero_before", "orig_zero_after", "dest_zero_before",
    "hour_of_day", "day_of_week", "step_mod_24", "type_encoded",
    "orig_tx_count", "orig_total_sent", "orig_unique_dests",
]


def type_amount_stats(df: DataFrame) -> DataFrame:
    """C2 stats: per type mean and sample std of amount."""
    return df.groupBy("type").agg(
        F.avg("amount").alias("type_mean"), F.stddev_samp("amount").alias("type_std")
    )


def type_index(df: DataFrame) -> DataFrame:
    """C11: 0-based rank of each type among the sorted distinct types.

    The window runs on the distinct-type table only (a handful of rows)."""
    types = df.select("type").where(F.col("type").isNotNull()).distinct()
    w = Window.orderBy("type")
    return types.select("type", (F.dense_rank().over(w) - 1).cast("int").alias("type_encoded"))


def origin_stats(df: DataFrame) -> DataFrame:
    """Per origin row count (non-null labels), amount sum, distinct
    destinations, computed as (origin, destination) partials then origin."""
    pairs = df.groupBy("nameOrig", "nameDest").agg(
        F.count("isFraud").alias("_n"), F.sum("amount").alias("_s")
    )
    return pairs.groupBy("nameOrig").agg(
        F.sum("_n").alias("orig_tx_count"),
        F.sum("_s").alias("orig_total_sent"),
        F.count("nameDest").alias("orig_unique_dests"),
    )


def engineer_features(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """The raw columns plus the 21 engineered columns, in reference order."""
    fit = df if fit is None else fit
    types = type_amount_stats(fit).select(
        "*", (F.dense_rank().over(Window.orderBy(F.col("type").asc_nulls_last())) - 1).cast("int").alias("type_encoded")
    ).where(F.col("type").isNotNull())
    orig = origin_stats(fit)
    base = df.select("*", *X.row_features())
    joined = (
        base.join(checked_broadcast(types), "type", "left")
        .join(orig, "nameOrig", "left")
    )
    zscore = (F.col("amount") - F.col("type_mean")) / (F.col("type_std") + F.lit(ZSCORE_EPS))
    with_z = joined.withColumn("amount_zscore", zscore)
    return with_z.select(*df.columns, *ENGINEERED_COLS)


def feature_matrix(df: DataFrame, keep: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """C17: the model columns in order, as doubles, null/NaN -> 0."""
    cols = cols or FEATURE_COLS
    keep = keep or []
    filled = [
        F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols
    ]
    return df.select(*keep, *filled)


def assemble(df: DataFrame, cols: list[str] | None = None, output: str = "features") -> DataFrame:
    """Vector column for MLlib from the (already filled) model columns."""
    from pyspark.ml.feature import VectorAssembler

    cols = cols or FEATURE_COLS
    return VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="keep").transform(df)
