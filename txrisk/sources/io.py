"""A: scans, sinks and request validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.sources.schema import RAW_COLUMNS, STREAM_SCHEMA, TX_SCHEMA


def require_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: fail at plan time when required columns are missing."""
    cols = cols or RAW_COLUMNS
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def with_tx_id(df: DataFrame) -> DataFrame:
    """Give rows a ``tx_id`` when the source has none.

    ``monotonically_increasing_id`` is unique, but Spark packs file splits by
    size, so it does not follow the order of the files. Operators that need an
    arrival order (H1, E2, E15) need a source with its own ``tx_id``, or one
    derived from an ordering column; assign ids once and write the table."""
    if "tx_id" in df.columns:
        return df
    return df.select(F.monotonically_increasing_id().alias("tx_id"), *df.columns)


def scan_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1: transactions from CSV (header, fixed types, no inference) or parquet,
    columns taken by name in any order; other columns are left out."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    known = {f.name: f for f in TX_SCHEMA.fields}
    if fmt == "csv":
        header = require_columns(spark.read.option("header", True).csv(path)).columns
        schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        df = require_columns(spark.read.parquet(path))
    df = df.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in known.items() if c in df.columns])
    return with_tx_id(df)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A3/A4/A5: parquet sink (optionally partitioned, e.g. by ``split``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read back a written table; ``split`` filters a partition column (pruned)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_features(df: DataFrame, path: str) -> None:
    write_table(df, path)


def write_splits(df: DataFrame, scaler_params: DataFrame, path: str) -> None:
    """A4: the split table partitioned by ``split`` plus the scaler table."""
    write_table(df, f"{path}/rows", ["split"])
    write_table(scaler_params.coalesce(1), f"{path}/scaler")


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, f"{path}/rows", split), spark.read.parquet(f"{path}/scaler")


def write_graph(nodes: DataFrame, edges: DataFrame, node_features: DataFrame, path: str) -> None:
    """A5: graph tables persisted together."""
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")
    write_table(node_features, f"{path}/node_features")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "node_features"))  # type: ignore[return-value]


REPORT_SCHEMA = T.StructType(
    [
        T.StructField(
            "metrics",
            T.StructType(
                [T.StructField(n, T.DoubleType()) for n in ("auprc", "auc_roc", "f1", "precision")]
                + [T.StructField(n, T.LongType()) for n in ("tn", "fp", "fn", "tp")]
            ),
        ),
        T.StructField(
            "feature_importance", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
        ),
    ]
)


def metrics_report(metrics_row: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """One-row report: ``metrics`` struct and ``feature_importance``
    map of model -> (feature -> importance)."""
    m = metrics_row.select(
        F.struct(
            *[F.col(n).cast("double").alias(n) for n in ("auprc", "auc_roc", "f1", "precision")],
            *[F.col(n).cast("long").alias(n) for n in ("tn", "fp", "fn", "tp")],
        ).alias("metrics")
    )
    if importances is None:
        return m.withColumn(
            "feature_importance", F.create_map().cast("map<string,map<string,double>>")
        )
    per_model = importances.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("imp")
    )
    fi = per_model.agg(F.map_from_entries(F.collect_list(F.struct("model", "imp"))).alias("feature_importance"))
    one = F.lit(1).alias("_k")
    return m.select("*", one).join(fi.select("*", one), "_k").drop("_k")


def write_metrics_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def read_metrics_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def validate_rows(df: DataFrame) -> DataFrame:
    """A10: request checks (step >= 0, amount > 0, required fields present) as
    a ``valid`` flag and a ``reason`` for the rejected rows. Filter on
    ``valid`` for the accepted rows and on its negation for the quarantine."""
    checks = [
        (F.col("step").isNull() | (F.col("step") < 0), "step must be >= 0"),
        (F.col("amount").isNull() | (F.col("amount") <= 0), "amount must be > 0"),
    ]
    for c in ("type", "nameOrig", "nameDest", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"):
        checks.append((F.col(c).isNull(), f"{c} is required"))
    reason = F.concat_ws("; ", *[F.when(cond, F.lit(msg)) for cond, msg in checks])
    return df.select("*", (reason == "").alias("valid"), F.when(reason == "", None).otherwise(reason).alias("reason"))


#: Name of the counters that ``counted`` observes.
REQUESTS = "requests"


def counted(validated: DataFrame, observation: Observation | str = REQUESTS, label: str | None = "isFraud") -> DataFrame:
    """Rows of ``validate_rows``, counted on their way to wherever they
    are written: total, valid, rejected, rejections by field and, of valid rows,
    those of the ``label`` and their amount. No second pass; in a stream the
    counters are in each batch's progress under the name given."""
    ok = F.col("valid")
    fields = ("step", "amount", "type", "nameOrig", "nameDest")
    broken = [F.count_if(F.coalesce(F.col("reason"), F.lit("")).rlike(rf"(^|; ){c} (must|is)")).alias(f"bad_{c}") for c in fields]
    has_label = label is not None and label in validated.columns
    return validated.observe(
        observation, F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"), *broken,
        *([F.coalesce(F.sum(F.when(ok, F.col(label))), F.lit(0)).cast("long").alias("fraud_count")] if has_label else []),
        F.coalesce(F.sum(F.when(ok, F.col("amount"))), F.lit(0.0)).alias("amount"),
    )


def write_validated(df: DataFrame, path: str) -> dict:
    """A10: valid rows and quarantined ones written in one pass, as two partitions
    of one table (column ``valid``); returns the counters of that pass."""
    seen = Observation(REQUESTS)
    write_table(counted(validate_rows(df), seen), path, ["valid"])
    return seen.get


def read_validated(spark: SparkSession, path: str, valid: bool | None = None) -> DataFrame:
    """What ``write_validated`` wrote; ``valid`` reads one part only (pruned)."""
    rows = spark.read.parquet(path)
    part = rows if valid is None else rows.where(F.col("valid") == F.lit(valid).cast("string"))
    return part.withColumn("valid", F.col("valid").cast("boolean"))


def requests_from_json(spark: SparkSession, lines: DataFrame, column: str = "value") -> DataFrame:
    """Batch request bodies (``{"transactions": [...]}``) to rows."""
    item = T.StructType([f for f in STREAM_SCHEMA.fields])
    body = T.StructType([T.StructField("transactions", T.ArrayType(item))])
    parsed = lines.select(F.from_json(F.col(column), body).alias("b"))
    return parsed.select(F.explode("b.transactions").alias("t")).select("t.*")

