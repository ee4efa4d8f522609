"""Distributed building blocks used by several operators.

* ``checked_broadcast``: broadcast a side only after its size is known to be
  under a bound; above the bound the plain (shuffle) join is kept.
* ``running_totals``: exact global running sums over a total order without a
  single-partition window: rows are dealt into ranges of values, summed by a
  window inside a range, and offset by the totals of the ranges before.
* ``checkpointed``: reliable checkpoint into the session's shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import ensure_checkpoint_dir

# Rows above which a "small" side is not broadcast.
DEFAULT_BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``.

    The side is persisted first, so the row count and the join reuse one
    evaluation. Use it for aggregates whose cardinality is data dependent
    (types, classes, thresholds); AQE still handles everything else.
    """
    small = df.persist()
    n = small.count()
    return F.broadcast(small) if n <= max_rows else small


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (shared folder from ``spark.checkpoint.dir``).

    The frame is persisted while it is written, so the checkpoint job reads
    the cached blocks instead of recomputing the plan; the returned frame's
    plan is a single scan of the checkpoint files (lineage cut)."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=eager)
    if eager:
        cached.unpersist()
    return out


def _sort_exprs(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def _at_or_after(order: Sequence[tuple[str, bool]], bound: Sequence) -> Column:
    """Whether a row sorts at or after ``bound`` (Spark's null order: first
    when ascending, last when descending)."""
    test = F.lit(True)
    for (name, asc), value in reversed(list(zip(order, bound))):
        c = F.col(name)
        if value is None:
            beyond = c.isNotNull() if asc else F.lit(False)
        else:
            beyond = F.coalesce(c > F.lit(value), F.lit(False)) if asc else c.isNull() | (c < F.lit(value))
        test = beyond | (c.eqNullSafe(F.lit(value)) & test)
    return test


def range_bucket(df: DataFrame, order: Sequence[tuple[str, bool]], buckets: int) -> Column:
    """Number of the value range that a row falls into, as an expression.

    Range bounds are taken once, as values, from a sample of about 50 rows a
    bucket, and searched by a balanced CASE tree. A wrong guess of the sample
    makes ranges uneven, never wrong: the bucket depends on the row's values
    alone, so every evaluation of the plan gives the same one."""
    names = [c for c, _ in order]
    n = df.count()
    wanted = 50 * buckets
    sample = df.select(*names) if n <= wanted else df.select(*names).sample(min(1.0, 1.2 * wanted / n), seed=11)
    rows = [tuple(r) for r in sample.distinct().orderBy(*_sort_exprs(order)).limit(2 * wanted).collect()]
    step = len(rows) / buckets
    bounds = sorted({int(i * step) for i in range(1, buckets)} - {0}) if len(rows) > 1 else []
    bounds = [rows[i] for i in bounds]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_at_or_after(order, bounds[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds))


def running_totals(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sum_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    prefix: str = "cum_",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sum_cols``.

    ``order`` is a list of (column, ascending) that must be a unique key
    within each group (ties are broken by it, never by arrival). With
    ``group_cols`` the sums restart per group. Rows are dealt into ranges of
    the order (``range_bucket``); a window sums inside a range and the totals
    of the ranges before it are added. No step puts more than one range of rows
    into a task.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, "_range"]
    full = [*[(g, True) for g in group_cols], *order]
    ranged = df.withColumn("_range", range_bucket(df, full, n))
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in sum_cols}
    totals = ranged.groupBy(*keys).agg(*[F.sum(value[c]).alias(f"_tot_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (range, group): bounded by the number of ranges times that
    # of the groups the caller asks for (labels, classes)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0.0)).alias(f"_off_{c}") for c in sum_cols],
    )
    within = Window.partitionBy(*keys).orderBy(*_sort_exprs(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_loc_{c}": F.sum(value[c]).over(within) for c in sum_cols})
    match = [local[k].eqNullSafe(offsets[f"_o_{k}"]) for k in keys]
    return local.join(offsets, match).select(
        *[local[c] for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in sum_cols],
    )


def group_quantiles(
    df: DataFrame,
    value_col: str,
    tie_col: str,
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default) per group.

    Rows are ranked by a distributed sort (``running_totals`` on a count
    column, ties broken by ``tie_col``); only the rows at the two ranks around
    each quantile position are kept and interpolated. No group is ever held
    in one buffer, unlike the exact ``percentile`` aggregate.
    """
    gcols = list(group_cols)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    vals = df.where(F.col(value_col).isNotNull())
    synthetic = not gcols
    if synthetic:
        vals = vals.withColumn("_g", F.lit(0))
        gcols = ["_g"]
    vals = vals.select(*gcols, value_col, tie_col)
    counts = vals.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(
        vals.withColumn("_one", F.lit(1.0)), [(value_col, True), (tie_col, True)], ["_one"], gcols
    ).withColumn("_rank", F.col("cum__one").cast("long") - 1)
    with_n = ranked.join(checked_broadcast(counts), gcols, "inner")
    position = {name: (F.col("_n") - 1) * F.lit(float(p)) for p, name in zip(probs, names)}
    picks = []
    for name, pos in position.items():
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when(F.col("_rank") == at.cast("long"), F.col(value_col))).alias(f"_{side}_{name}"))
    per = with_n.groupBy(*gcols, "_n").agg(*picks)
    out = per.select(
        *gcols,
        *[
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (pos - F.floor(pos))).alias(name)
            for name, pos in position.items()
        ],
    )
    return out.drop("_g") if synthetic else out
