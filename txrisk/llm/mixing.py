"""Mixing sources to target weights by iterative proportional fitting.

Token totals are summed per (source, language, topic) cell; the cell weights
are raked in turn to the target share of each margin, and documents are
sampled at the cell's calibrated rate: whole copies, and a draw on the fraction.
DataFrame operations only: cells stay a table, so any number of sources will do.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm._common import materialise, words

MISSING = "(none)"
#: Share given to a category that a target does not name, before shares are scaled to sum to one.
UNNAMED = 0.02


def _target(dim: str, shares: Mapping[str, float] | None) -> Column:
    """Unscaled target of a category: its given share, or one each."""
    if shares is None:
        return F.lit(1.0)
    value = F.lit(UNNAMED)
    for name, share in shares.items():
        value = F.when(F.col(dim) == name, F.lit(float(share))).otherwise(value)
    return value


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | None], rounds: int = 20, cut_every: int = 4) -> DataFrame:
    """``cells`` (dimensions, tokens) plus weight: shares that sum to one and
    meet the margins of ``targets`` (dimension: category shares, or None for
    equal shares), starting from the token shares. Categories present are
    scaled to sum to one. A cell without tokens weighs nothing. Where cells are
    missing so that no table meets all margins, the last dimension's margin
    holds and the others are as near as ``rounds`` bring them."""
    cells = materialise(cells, "cells")
    for dim, shares in targets.items():
        names = cells.groupBy(dim).agg(F.sum("tokens").alias("__n")).where("__n > 0")
        names = names.select(dim, _target(dim, shares).alias("__t"))
        total = names.agg(F.sum("__t")).first()[0]
        names = names.select(dim, (F.col("__t") / F.lit(total or 1.0)).alias(f"__to_{dim}"))
        cells = cells.join(names, dim, "left")
    whole = cells.agg(F.sum("tokens").cast("double")).first()[0]
    fitted = materialise(cells.withColumn("weight", F.col("tokens") / F.lit(whole)), "cells")
    for n in range(1, rounds + 1):
        for dim in targets:
            held = F.sum("weight").over(Window.partitionBy(dim))
            fitted = fitted.withColumn(
                "weight", F.when(held > 0, F.col("weight") * F.col(f"__to_{dim}") / held).otherwise(F.lit(0.0))
            )
        if n % cut_every == 0 or n == rounds:
            fitted = materialise(fitted, "cells")
    return fitted.drop(*[f"__to_{d}" for d in targets])


def uniform_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the key's text and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | None],
    share: float = 0.5,
    topic: Column | None = None,
    seed: int = 7,
    rounds: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` plus topic, n_tokens, weight, probability, draw, sampled and copies.

    ``targets`` names the dimensions to rake (columns, or ``topic``). n_tokens
    is the number of words. weight is the raked share of the row's cell per
    share of tokens that it has, and share * weight the row's rate. copies is the
    whole part of the rate, and one more if the draw, a hash of the row's id, is
    below the rest, so the expected sample (each row ``copies`` times, see
    ``sample``) has ``share`` of the tokens in the target mix. probability is
    min(1, rate): that of at least one copy, which sampled tells. Columns of
    these names are replaced. Null dimensions are a
    category of their own; null and empty texts have no tokens and, in a cell
    without tokens, probability 0; repeated rows share their draw; an empty
    table gives no rows.
    """
    dims = list(targets)
    made = {"topic", "n_tokens", "weight", "probability", "draw", "sampled", "copies"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    keys = [f"k{i}" for i in range(len(dims))]
    base = docs.select(
        F.struct(*own).alias("doc"),
        (F.lit("all") if topic is None else topic).alias("topic"),
        F.size(words(F.col(text_col))).cast("long").alias("n_tokens"),
        F.col(id_col).alias("id"),
    )
    of = {d: F.col("topic") if d == "topic" else F.col("doc")[d] for d in dims}
    base = base.withColumns({k: F.coalesce(of[d].cast("string"), F.lit(MISSING)) for k, d in zip(keys, dims)})
    cells = base.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, {k: targets[d] for k, d in zip(keys, dims)}, rounds)
    whole = raked.agg(F.sum("tokens").cast("double")).first()[0]
    per_token = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(whole) / F.col("tokens")).otherwise(0.0)
    odds = raked.select(*keys, F.round(per_token, 6).alias("weight"))
    joined = base.join(odds, keys, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    rate = F.round(F.lit(share) * F.col("weight"), 6)
    joined = joined.withColumn("rate", rate).withColumn("probability", F.least(F.lit(1.0), F.col("rate")))
    joined = joined.withColumn("draw", uniform_draw(F.col("id"), seed))
    whole_copies = F.floor("rate")
    copies = whole_copies + (F.col("draw") < F.col("rate") - whole_copies).cast("long")
    return joined.select(
        "doc.*", "topic", "n_tokens", "weight", "probability", "draw",
        (F.col("draw") < F.col("probability")).alias("sampled"), copies.alias("copies"),
    )


def sample(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` as often as their copies say, numbered by copy (1, 2, ...)."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
