"""Fixed schemas and column lists.

Fixed values below must equal the reference's for right results: the raw
column names, the 26 model feature names in their model order, the
transaction type code map and the graph feature names.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw transaction columns (the reference's required set) ---
RAW_COLUMNS = [
    "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
    "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
]

# --- fixed values: model feature columns, in model order ---
FEATURE_COLS = [
    "amount", "amount_log", "amount_zscore", "is_round_amount",
    "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "balance_diff_orig", "balance_diff_dest",
    "balance_ratio_orig", "balance_ratio_dest",
    "orig_balance_error", "dest_balance_error",
    "has_orig_error", "has_dest_error",
    "orig_zero_before", "orig_zero_after", "dest_zero_before",
    "hour_of_day", "day_of_week", "step_mod_24",
    "type_encoded",
    "orig_tx_count", "orig_total_sent", "orig_unique_dests",
]

# --- fixed values: transaction type codes used at scoring time; unknown -> 0 ---
TYPE_CODES = {"CASH_IN": 0, "CASH_OUT": 1, "DEBIT": 2, "PAYMENT": 3, "TRANSFER": 4}

# --- fixed values: structural graph feature columns, in model order ---
GRAPH_FEATURE_COLS = [
    "in_degree", "out_degree", "degree",
    "weighted_in_deg", "weighted_out_deg",
    "pagerank", "betweenness", "clustering_coeff",
    "avg_neighbor_deg", "local_fraud_rate",
]

# --- fixed values: per-account tabular columns appended to graph features ---
ACCOUNT_AGGS = [
    ("amount", "mean"),
    ("amount_log", "mean"),
    ("balance_diff_orig", "mean"),
    ("balance_diff_dest", "mean"),
    ("orig_tx_count", "first"),
    ("orig_total_sent", "first"),
    ("orig_unique_dests", "first"),
    ("type_encoded", "mean"),
]

# --- fixed values: time split cut points (inclusive upper bounds) ---
TRAIN_MAX_STEP = 600
VAL_MAX_STEP = 672
STEPS_PER_PERIOD = 744

TX_SCHEMA = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isFlaggedFraud", T.IntegerType()),
    ]
)

# stream rows carry no labels
STREAM_SCHEMA = T.StructType([f for f in TX_SCHEMA.fields if f.name not in ("isFraud", "isFlaggedFraud")])

TX_COLUMNS = [f.name for f in TX_SCHEMA.fields]
