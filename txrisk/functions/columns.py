"""Row-level column expressions (built-in Spark functions only, codegen-friendly).

Every function returns a ``Column`` over the canonical transaction columns, so
callers compose them in one ``select`` and Catalyst keeps them in a single
whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.sources.schema import TYPE_CODES

# --- fixed values: rule engine weights and cut-offs (scoring rules) ---
RULE_HIGH_RISK_TYPES = ("CASH_OUT", "TRANSFER")
RULE_W_TYPE = 0.20
RULE_W_DRAINED = 0.30
RULE_W_LARGE = 0.15
RULE_LARGE_AMOUNT = 500_000.0
RULE_W_DEST_UNCHANGED = 0.25
RULE_W_ROUND = 0.10
RULE_ROUND_UNIT = 100_000.0
RULE_CAP = 1.0

# --- fixed values: risk bands (lower bounds, inclusive) ---
RISK_BANDS = [(0.90, "CRITICAL"), (0.70, "HIGH"), (0.50, "MEDIUM")]
RISK_DEFAULT = "LOW"

# --- fixed values: alert reason texts, in emission order ---
REASON_TYPE = "High-risk tx type ({})"
REASON_DRAINED = "Origin account fully drained"
REASON_DEST_UNCHANGED = "Destination balance unchanged (possible layering)"
REASON_LARGE = "Very large amount (${})"
REASON_LARGE_AMOUNT = 1_000_000.0
REASON_RULE = "Rule engine score: {}"
REASON_RULE_MIN = 0.5
REASON_ML = "ML model confidence: {}%"
REASON_ML_MIN = 0.7
REASON_DEFAULT = "ML model flagged"
REASON_SEP = "; "

# --- fixed values: rule uplift in the blend ---
RULE_BLEND_WEIGHT = 0.1

c = F.col


def as_int(cond: Column) -> Column:
    return cond.cast("int")


# ---------------------------------------------------------------- C features
def amount_log() -> Column:
    return F.log1p(c("amount"))


def is_round_amount() -> Column:
    return as_int(c("amount") % 100 == 0)


def balance_diff(new: str, old: str) -> Column:
    return c(new) - c(old)


def balance_ratio(new: str, old: str) -> Column:
    # pandas gives inf on old == -1; ANSI Spark would raise: null instead,
    # mapped to 0 with the other missing values at feature-matrix time.
    return F.try_divide(c(new), c(old) + F.lit(1.0))


def orig_balance_error() -> Column:
    return F.abs(F.greatest(c("oldbalanceOrg") - c("amount"), F.lit(0.0)) - c("newbalanceOrig"))


def dest_balance_error() -> Column:
    return F.abs(c("oldbalanceDest") + c("amount") - c("newbalanceDest"))


def hour_of_day() -> Column:
    return F.pmod(c("step"), F.lit(24))


def day_of_week() -> Column:
    return F.pmod(F.floor(c("step") / F.lit(24)).cast("int"), F.lit(7))


def type_code() -> Column:
    """Fixed code map for scoring; unknown types map to 0."""
    m = F.create_map(*[x for k, v in TYPE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, c("type")), F.lit(0))


def row_features() -> list[Column]:
    """The row-local engineered columns (C1, C3-C10), in table order."""
    return [
        amount_log().alias("amount_log"),
        is_round_amount().alias("is_round_amount"),
        balance_diff("newbalanceOrig", "oldbalanceOrg").alias("balance_diff_orig"),
        balance_diff("newbalanceDest", "oldbalanceDest").alias("balance_diff_dest"),
        balance_ratio("newbalanceOrig", "oldbalanceOrg").alias("balance_ratio_orig"),
        balance_ratio("newbalanceDest", "oldbalanceDest").alias("balance_ratio_dest"),
        orig_balance_error().alias("orig_balance_error"),
        dest_balance_error().alias("dest_balance_error"),
        as_int(orig_balance_error() > 0.01).alias("has_orig_error"),
        as_int(dest_balance_error() > 0.01).alias("has_dest_error"),
        as_int(c("oldbalanceOrg") == 0).alias("orig_zero_before"),
        as_int(c("newbalanceOrig") == 0).alias("orig_zero_after"),
        as_int(c("oldbalanceDest") == 0).alias("dest_zero_before"),
        hour_of_day().alias("hour_of_day"),
        day_of_week().alias("day_of_week"),
        hour_of_day().alias("step_mod_24"),
    ]


# ---------------------------------------------------------------- H scoring
def rule_score() -> Column:
    """Additive rule score in fixed order, capped at 1."""
    high_type = c("type").isin(*RULE_HIGH_RISK_TYPES)
    drained = (c("oldbalanceOrg") > 0) & (c("newbalanceOrig") == 0)
    large = c("amount") > RULE_LARGE_AMOUNT
    dest_same = (c("oldbalanceDest") == c("newbalanceDest")) & (c("amount") > 0)
    round_amt = ((c("amount") % RULE_ROUND_UNIT) == 0) & (c("amount") > 0)
    s = F.lit(0.0)
    for cond, w in (
        (high_type, RULE_W_TYPE),
        (drained, RULE_W_DRAINED),
        (large, RULE_W_LARGE),
        (dest_same, RULE_W_DEST_UNCHANGED),
        (round_amt, RULE_W_ROUND),
    ):
        s = s + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    return F.least(s, F.lit(RULE_CAP))


def risk_level(p: Column) -> Column:
    out = None
    for lo, name in RISK_BANDS:
        out = F.when(p >= lo, F.lit(name)) if out is None else out.when(p >= lo, F.lit(name))
    return out.otherwise(F.lit(RISK_DEFAULT))


def blend_rule(p: Column, rule: Column) -> Column:
    return F.least(p + rule * F.lit(RULE_BLEND_WEIGHT), F.lit(1.0))


def _fmt(template: str, spec: str) -> str:
    return template.replace("%", "%%").replace("{}", spec)


def alert_reason(p: Column, rule: Column) -> Column:
    """Ordered reasons joined with '; ' (nulls skipped), default when none."""
    parts = [
        F.when(
            c("type").isin(*RULE_HIGH_RISK_TYPES),
            F.format_string(_fmt(REASON_TYPE, "%s"), c("type")),
        ),
        F.when((c("newbalanceOrig") == 0) & (c("oldbalanceOrg") > 0), F.lit(REASON_DRAINED)),
        F.when(c("oldbalanceDest") == c("newbalanceDest"), F.lit(REASON_DEST_UNCHANGED)),
        F.when(
            c("amount") > REASON_LARGE_AMOUNT,
            F.format_string(_fmt(REASON_LARGE, "%s"), F.format_number(c("amount"), 0)),
        ),
        F.when(
            rule > REASON_RULE_MIN,
            F.format_string(_fmt(REASON_RULE, "%.2f"), F.bround(rule, 2)),
        ),
        F.when(
            p > REASON_ML_MIN,
            F.format_string(_fmt(REASON_ML, "%.2f"), F.bround(p * 100, 2)),
        ),
    ]
    joined = F.concat_ws(REASON_SEP, *parts)
    return F.when(joined == "", F.lit(REASON_DEFAULT)).otherwise(joined)
