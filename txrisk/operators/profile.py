"""B: profiling tables (the dashboard's and the loader's summaries as DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import columns as X
from txrisk.functions.distributed import group_quantiles

# --- fixed values: columns correlated with the label on the analysis page ---
CORRELATION_COLS = [
    "amount_log", "balance_diff_orig", "balance_diff_dest",
    "balance_ratio_orig", "balance_ratio_dest",
    "has_orig_error", "has_dest_error",
    "orig_zero_before", "orig_zero_after", "is_round_amount",
]

# --- fixed values: features selectable on the analysis page ---
DISTRIBUTION_FEATURES = [
    "amount", "balance_diff_orig", "balance_diff_dest",
    "balance_ratio_orig", "orig_tx_count", "orig_total_sent",
]

# --- fixed values: network sample and its drawing ---
SAMPLE_FRAUD_MAX = 30
NODE_SIZE_BASE, NODE_SIZE_PER_DEGREE, NODE_SIZE_MAX = 15, 2, 40
NODE_LABEL_CHARS, NODE_LABEL_SUFFIX = 6, "…"
EDGE_WIDTH_BASE, EDGE_WIDTH_UNIT, EDGE_WIDTH_MAX = 1.0, 100_000.0, 5.0
COLOR_FRAUD, COLOR_NODE, COLOR_EDGE = "#ff4757", "#57a0ff", "#aaaaaa"


def fraud_rate(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """B1: mean of the label."""
    return df.agg(F.avg(label).alias("fraud_rate"))


def type_counts(df: DataFrame) -> DataFrame:
    """B2: rows per type, most frequent first."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def rate_by(df: DataFrame, key: str, label: str = "isFraud") -> DataFrame:
    """Label sum, row count and rate per key."""
    return df.groupBy(key).agg(
        F.sum(label).cast("long").alias("fraud"),
        F.count(F.lit(1)).alias("n"),
        (F.sum(label) / F.count(F.lit(1))).alias("rate"),
    )


def fraud_by_type(df: DataFrame) -> DataFrame:
    return rate_by(df, "type")


def fraud_by_hour(df: DataFrame) -> DataFrame:
    if "hour_of_day" not in df.columns:
        df = df.withColumn("hour_of_day", X.hour_of_day())
    return rate_by(df, "hour_of_day")


def split_summary(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Rows and label rate per split (needs a ``split`` column)."""
    return (
        df.where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("fraud_rate"))
    )


def kpi_summary(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Total rows, fraud rows, fraud percentage."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(label).cast("long").alias("fraud_count"),
        (F.sum(label) / F.count(F.lit(1)) * 100).alias("fraud_pct"),
    )


def log_amount_histogram(df: DataFrame, bins: int = 50, label: str = "isFraud") -> DataFrame:
    """Equal-width histogram of log1p(amount) per class over the global range.

    The range is two scalars (one aggregate), used as literals; the counts are
    a map-side-combined ``groupBy``."""
    x = F.log1p(F.col("amount"))
    vals = df.where(F.col("amount").isNotNull()).select(F.col(label).alias("label"), x.alias("x"))
    mn, mx = vals.agg(F.min("x"), F.max("x")).first()
    if mn is None:
        return vals.limit(0).select("label", F.lit(0).alias("bin"), F.lit(0.0).alias("bin_lo"),
                                    F.lit(0.0).alias("bin_hi"), F.lit(0).cast("long").alias("n"))
    span = (mx - mn) if mx > mn else 1.0
    b = F.least(F.floor((F.col("x") - F.lit(mn)) / F.lit(span) * F.lit(bins)).cast("int"), F.lit(bins - 1))
    out = vals.groupBy("label", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        "label",
        "bin",
        (F.lit(mn) + F.col("bin") * F.lit(span) / F.lit(bins)).alias("bin_lo"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(span) / F.lit(bins)).alias("bin_hi"),
        "n",
    )


def distribution_by_class(df: DataFrame, feature: str, label: str = "isFraud", tie: str = "tx_id") -> DataFrame:
    """Per class quartiles (exact, linear), min, max, mean; amount is log1p'd."""
    v = F.log1p(F.col(feature)) if feature == "amount" else F.col(feature)
    vals = df.select(F.col(label).alias("label"), v.alias("v"), F.col(tie).alias("_tie")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    q = group_quantiles(vals, "v", "_tie", [0.25, 0.5, 0.75], ["label"], ["q1", "median", "q3"])
    simple = vals.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")
    )
    return simple.join(q, "label", "left").select(
        F.lit(feature).alias("feature"), "label", "n", "min", "q1", "median", "q3", "max", "mean"
    )


def sketch_rank_error(k: int) -> float:
    """Rank error that a KLL sketch of size ``k`` keeps to with 99% confidence (published fit)."""
    return 2.296 / k**0.9021


def distribution_sketches(df: DataFrame, features: list[str] | None = None, label: str = "isFraud", k: int = 1024) -> DataFrame:
    """B8, approximate and mergeable: one row a feature and class with n, min, max,
    mean and a KLL ``sketch`` of the values (amount is log1p'd), all features in
    one pass and one map-side-combined aggregate.

    The rows can be stored and merged (``merge_distributions``), so a day's
    sketches make the month's without its rows. Nulls and NaN are left out; a
    class without values has no row."""
    features = list(features or DISTRIBUTION_FEATURES)
    values = {c: F.log1p(F.col(c)) if c == "amount" else F.col(c).cast("double") for c in features}
    rows = df.select(F.col(label).alias("label"), *[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(values.values())])
    held = rows.groupBy("label").agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("min"), F.max(f"v{i}").alias("max"),
            F.avg(f"v{i}").alias("mean"), F.kll_sketch_agg_double(f"v{i}", k).alias("sketch"),
        ).alias(f"s{i}")
        for i, c in enumerate(features)
    ])
    listed = held.select("label", F.explode(F.array(*[F.col(f"s{i}") for i in range(len(features))])).alias("s"))
    return listed.select("s.feature", "label", "s.n", "s.min", "s.max", "s.mean", "s.sketch").where("n > 0")


def merge_distributions(sketches: DataFrame, k: int = 1024) -> DataFrame:
    """Rows of ``distribution_sketches`` of several parts as those of the whole."""
    return sketches.groupBy("feature", "label").agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )


def sketched_quartiles(sketches: DataFrame) -> DataFrame:
    """B8's columns from sketches: quartiles within the rank error of their size."""
    at = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(c) for c, p in at.items()]
    return sketches.select("feature", "label", "n", "min", *quartiles, "max", "mean")


def label_correlation(df: DataFrame, label: str = "isFraud", cols: list[str] | None = None) -> DataFrame:
    """Pearson r of each present column with the label, ascending.

    One aggregate computes every coefficient; ``stack`` turns it into rows.
    A constant column gives null (pandas: NaN)."""
    cols = [c for c in (cols or CORRELATION_COLS) if c in df.columns]
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, corr)").orderBy(
        F.col("corr").asc_nulls_last(), "feature"
    )


def network_rows(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """The rows of a network: exact-duplicate removal on the transaction columns;
    ``part`` puts fraud rows before normal ones, for B11's last-write-wins."""
    part = F.when(F.col(label) == 1, 0).otherwise(1)
    raw = [c for c in df.columns if c != "tx_id"]
    return df.withColumn("part", part).groupBy(*raw).agg(F.min(F.struct("part", "tx_id")).alias("_k")).select(
        F.col("_k.tx_id").alias("tx_id"), *raw, F.col("_k.part").alias("part")
    )


def network_sample(df: DataFrame, n: int = 150, label: str = "isFraud") -> DataFrame:
    """B10, a display of ``n`` rows: first min(30, n//4) fraud rows and first n normal rows (by step, tx_id),
    UNION ALL, then exact-duplicate removal on the transaction columns.

    Both heads are top-k (TakeOrderedAndProject), bounded by ``n``; ``part``
    keeps the concatenation order (fraud block first) for B11's last-write-wins."""
    k = min(SAMPLE_FRAUD_MAX, n // 4)
    fraud = df.where(F.col(label) == 1).orderBy("step", "tx_id").limit(k).withColumn("part", F.lit(0))
    normal = df.where(F.col(label) == 0).orderBy("step", "tx_id").limit(n).withColumn("part", F.lit(1))
    both = fraud.unionByName(normal)
    raw = [c for c in df.columns if c != "tx_id"]
    return both.groupBy(*raw).agg(F.min(F.struct("part", "tx_id")).alias("_k")).select(
        F.col("_k.tx_id").alias("tx_id"), *raw, F.col("_k.part").alias("part")
    )


def _sample_events(sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """Node-attribute writes in sample order: (account, flag, order)."""
    return sample.select(
        F.col("nameOrig").alias("account"), F.col(label).alias("flag"),
        F.struct("part", "step", "tx_id", F.lit(0).alias("role")).alias("ord"),
    ).unionByName(
        sample.select(
            F.col("nameDest").alias("account"), F.lit(0).alias("flag"),
            F.struct("part", "step", "tx_id", F.lit(1).alias("role")).alias("ord"),
        )
    )


def sample_nodes(sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """Accounts of the sample with their last-written flag and degree."""
    ev = _sample_events(sample, label)
    last = ev.groupBy("account").agg(F.max_by("flag", "ord").alias("is_fraud"))
    edges = sample_edges(sample, label)
    deg = (
        edges.select(F.col("src").alias("account"))
        .unionAll(edges.select(F.col("dst").alias("account")))
        .groupBy("account")
        .agg(F.count(F.lit(1)).alias("degree"))
    )
    return last.join(deg, "account", "left").na.fill(0, ["degree"])


def sample_edges(sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """Distinct (src, dst) pairs of the sample; the last row's attributes win."""
    last = sample.groupBy(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst")).agg(
        F.max_by(F.struct("amount", F.col(label).alias("is_fraud")), F.struct("part", "step", "tx_id")).alias("a")
    )
    return last.select("src", "dst", "a.amount", "a.is_fraud")


def network_summary(sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """Nodes, edges, fraud nodes, fraud edges of the sampled graph."""
    nodes = sample_nodes(sample, label).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("is_fraud").cast("long").alias("fraud_nodes")
    )
    edges = sample_edges(sample, label).agg(
        F.count(F.lit(1)).alias("edges"), F.sum("is_fraud").cast("long").alias("fraud_edges")
    )
    # two one-row aggregates side by side (equi-join on a constant key)
    one = F.lit(1).alias("_k")
    return nodes.select("*", one).join(edges.select("*", one), "_k").select(
        "nodes", "edges", "fraud_nodes", "fraud_edges"
    )


def network_node_style(sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """B12 (nodes): size, colour and label of each account of the sample."""
    nodes = sample_nodes(sample, label)
    return nodes.select(
        "account",
        "is_fraud",
        "degree",
        F.least(F.lit(NODE_SIZE_BASE) + F.col("degree") * NODE_SIZE_PER_DEGREE, F.lit(NODE_SIZE_MAX))
        .cast("int")
        .alias("size"),
        F.when(F.col("is_fraud") == 1, F.lit(COLOR_FRAUD)).otherwise(F.lit(COLOR_NODE)).alias("color"),
        F.concat(F.substring("account", 1, NODE_LABEL_CHARS), F.lit(NODE_LABEL_SUFFIX)).alias("label"),
    )


def network_edge_style(sample: DataFrame, label: str = "isFraud") -> DataFrame:
    """B12 (edges): width, colour and title of each sampled edge."""
    edges = sample_edges(sample, label)
    return edges.select(
        "src",
        "dst",
        "is_fraud",
        F.least(F.lit(EDGE_WIDTH_BASE) + F.col("amount") / F.lit(EDGE_WIDTH_UNIT), F.lit(EDGE_WIDTH_MAX)).alias("width"),
        F.when(F.col("is_fraud") == 1, F.lit(COLOR_FRAUD)).otherwise(F.lit(COLOR_EDGE)).alias("color"),
        F.concat(F.lit("Amount: $"), F.format_number(F.col("amount"), 0)).alias("title"),
    )
