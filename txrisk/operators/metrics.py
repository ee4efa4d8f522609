"""G (and F6, F7): exact ranking and threshold metrics over (label, score).

Ranking curves work on the distinct-score table (map-side-combined
``groupBy(score)``), then take global running sums in descending score order
with ``running_totals`` (range partitions + broadcast per-partition offsets),
never with a single-partition window over raw rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.distributed import running_totals

EPS = 1e-9
HIST_EDGES = 50  # equal bins on [0, 1] from 50 edges -> 49 bins
SWEEP_START, SWEEP_STOP, SWEEP_NUM = 0.1, 0.95, 80


def sweep_thresholds(start: float = SWEEP_START, stop: float = SWEEP_STOP, num: int = SWEEP_NUM) -> list[float]:
    """Evenly spaced thresholds, both ends included (numpy linspace values)."""
    return [float(x) for x in np.linspace(start, stop, num)]


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("double").alias("neg"),
    )


def _cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    counts = score_counts(df, label, score)
    return running_totals(counts, [("score", False)], ["pos", "neg"])  # cum_pos = tp, cum_neg = fp


def _totals(df: DataFrame, label: str) -> tuple[float, float]:
    r = df.agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"),
    ).first()
    return float(r["p"] or 0), float(r["n"] or 0)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """G1: precision and recall at each distinct score (score >= threshold),
    plus the end point (precision 1, recall 0, threshold null)."""
    P, _ = _totals(df, label)
    cum = _cumulative(df, label, score)
    recall = (F.col("cum_pos") / F.lit(P)) if P > 0 else F.lit(1.0)
    pts = cum.select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        recall.alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], pts.schema)
    return pts.unionByName(end)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(fpr, tpr) at each distinct score, plus the origin (threshold null).
    Collinear points are kept."""
    P, N = _totals(df, label)
    cum = _cumulative(df, label, score)
    pts = cum.select(
        F.col("score").alias("threshold"),
        (F.col("cum_neg") / F.lit(N) if N > 0 else F.lit(None).cast("double")).alias("fpr"),
        (F.col("cum_pos") / F.lit(P) if P > 0 else F.lit(None).cast("double")).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], pts.schema)
    return start.unionByName(pts)


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """G3 + G4 in one pass over the curve: average precision (step sum
    of (R_n - R_n-1) * P_n) and ROC AUC (trapezoids). Null when a class is absent."""
    cum = _cumulative(df, label, score)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    s = cum.agg(
        F.sum(F.col("pos") * prec).alias("_ap"),
        F.sum(F.col("neg") * (F.lit(2.0) * F.col("cum_pos") - F.col("pos"))).alias("_auc"),
        F.sum("pos").alias("_P"),
        F.sum("neg").alias("_N"),
    )
    return s.select(
        F.when(F.col("_P") > 0, F.col("_ap") / F.col("_P")).alias("auprc"),
        F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_auc") / (F.lit(2.0) * F.col("_P") * F.col("_N"))).alias("auc_roc"),
    )


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("auprc")


def auc_roc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("auc_roc")


def predict(df: DataFrame, threshold: float = 0.5, score: str = "score", output: str = "prediction") -> DataFrame:
    """1 when score >= threshold."""
    return df.withColumn(output, (F.col(score) >= F.lit(threshold)).cast("int"))


def confusion(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """Tn, fp, fn, tp at the threshold (one conditional-sum aggregate)."""
    y = F.col(label) == 1
    p = F.col(score) >= F.lit(threshold)
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return df.agg(
        cnt(~y & ~p).alias("tn"), cnt(~y & p).alias("fp"), cnt(y & ~p).alias("fn"), cnt(y & p).alias("tp")
    )


def _prf(cm: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    f1_den = F.lit(2.0) * tp + fp + fn
    return cm.select(
        "*",
        (tp / (tp + fp + F.lit(EPS))).alias("precision"),
        (tp / (tp + fn + F.lit(EPS))).alias("recall"),
        F.when(f1_den > 0, F.lit(2.0) * tp / f1_den).otherwise(F.lit(0.0)).alias("f1"),
    )


def precision_recall_f1(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall with 1e-9 guards, F1 without (0 if undefined)."""
    return _prf(confusion(df, threshold, label, score))


def classification_report(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """Per class precision/recall/f1/support, accuracy, macro and weighted avg."""
    cm = confusion(df, threshold, label, score)

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p0, r0 = safe(tn, tn + fn), safe(tn, tn + fp)
    p1, r1 = safe(tp, tp + fp), safe(tp, tp + fn)
    f0 = safe(F.lit(2.0) * p0 * r0, p0 + r0)
    f1 = safe(F.lit(2.0) * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    rows = F.array(
        F.struct(F.lit("Legit").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("Fraud").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), safe(tn + tp, n).alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), safe(p0 * s0 + p1 * s1, n).alias("precision"),
                 safe(r0 * s0 + r1 * s1, n).alias("recall"), safe(f0 * s0 + f1 * s1, n).alias("f1"), n.alias("support")),
    )
    out = cm.select(F.inline(rows))
    return out.withColumn("support", F.col("support").cast("long"))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score", edges: int = HIST_EDGES) -> DataFrame:
    """49 equal bins on [0, 1] (last bin right-closed), density per class
    n / (N_class * width), every (class, bin) present (zeros included)."""
    nb = edges - 1
    width = 1.0 / nb
    s = F.col(score)
    inr = df.where((s >= 0) & (s <= 1)).select(F.col(label).alias("label"), F.least(F.floor(s * nb).cast("int"), F.lit(nb - 1)).alias("bin"))
    counts = inr.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = inr.groupBy("label").agg(F.count(F.lit(1)).alias("_N"))
    # grid: classes present x 49 bins (bounded: 49 rows per class)
    grid = totals.select("label", "_N", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bin"))
    j = grid.join(counts, ["label", "bin"], "left").na.fill(0, ["n"])
    return j.select(
        "label",
        "bin",
        (F.col("bin") * F.lit(width)).alias("bin_lo"),
        ((F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
        "n",
        (F.col("n") / (F.col("_N") * F.lit(width))).alias("density"),
    )


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall, f1 (1e-9 guards) at 80 thresholds 0.1..0.95 and
    the first maximum of f1 flagged.

    One plan: each distinct score is mapped to the number of thresholds it
    reaches (array filter against the 80 literals), counts are summed per
    bucket (81 buckets), and a suffix sum over that table gives the counts at
    or above each threshold. No range or theta join, no driver step."""
    ts = thresholds or sweep_thresholds()
    arr = F.array(*[F.lit(t) for t in ts])
    counts = score_counts(df, label, score)
    bucket = F.size(F.filter(arr, lambda t: t <= F.col("score")))
    per_bucket = counts.groupBy(bucket.alias("b")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # a row per number of thresholds reached: windows over len(ts) + 1 rows
    grid = df.sparkSession.range(len(ts) + 1).select(F.col("id").cast("int").alias("b"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    pos, neg = F.coalesce("pos", F.lit(0.0)), F.coalesce("neg", F.lit(0.0))
    at = grid.join(per_bucket, "b", "left").select(
        (F.col("b") - 1).alias("i"),
        F.sum(pos).over(above).alias("tp"),
        F.sum(neg).over(above).alias("fp"),
        F.sum(pos).over(Window.partitionBy()).alias("_P"),
    ).where(F.col("i") >= 0)
    tp, fp = F.col("tp"), F.col("fp")
    prec = tp / (tp + fp + F.lit(EPS))
    rec = tp / (F.col("_P") + F.lit(EPS))
    out = at.select("i", F.get(arr, F.col("i")).alias("threshold"), prec.alias("precision"), rec.alias("recall"))
    out = out.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS)))
    first = F.row_number().over(Window.orderBy(F.desc("f1"), "i")) == 1
    return out.withColumn("is_best", first)


def tune_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """over the PR curve (end point excluded), f1 = 2PR/(P+R+1e-9);
    the lowest threshold among the maxima (one row)."""
    pr = pr_curve(df, label, score).where(F.col("threshold").isNotNull())
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS))
    return pr.withColumn("f1", f1).orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def focal_loss(df: DataFrame, logit: str = "logit", label: str = "label", alpha: float = 0.25, gamma: float = 2.0, pos_weight: float = 1.0) -> DataFrame:
    """mean(alpha * (1 - exp(-bce))^gamma * bce), bce with pos_weight,
    in the stable softplus form."""
    x, y = F.col(logit), F.col(label).cast("double")

    def softplus(z):
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))

    bce = F.lit(pos_weight) * y * softplus(-x) + (F.lit(1.0) - y) * softplus(x)
    loss = F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-bce), F.lit(gamma)) * bce
    return df.agg(F.avg(loss).alias("focal_loss"))


def evaluate(df: DataFrame, threshold: float = 0.5, split: str = "Test", label: str = "label", score: str = "score") -> DataFrame:
    """One report row, metrics rounded to 4 decimals."""
    rank = ranking_metrics(df, label, score)
    prf = precision_recall_f1(df, threshold, label, score)
    one = F.lit(1).alias("_k")
    j = rank.select("*", one).join(prf.select("*", one), "_k")
    return j.select(
        F.lit(split).alias("split"),
        F.round("auprc", 4).alias("auprc"),
        F.round("auc_roc", 4).alias("auc_roc"),
        F.round("f1", 4).alias("f1"),
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
        "tp", "fp", "tn", "fn",
        F.lit(float(threshold)).alias("threshold"),
    )


def pr_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """Label prevalence (the PR baseline)."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("pr_baseline"))

