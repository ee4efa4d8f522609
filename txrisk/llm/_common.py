"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import scratch_path

#: Words are maximal runs of anything but space and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: While a step is written: its shuffle files go when it ends, and Python
#: workers get few rows at a time, since texts may be long.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the session's shared checkpoint folder and read back: cuts the
    lineage in a way that outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` evaluated once (a lambda variable keeps the
    optimizer from copying an expensive expression into every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Entries that a running total goes through one by one.
RUN = 256


def blocks_of(values: Column, body: Callable[[Column], Column]) -> Column:
    """Array of ``body`` of each stretch of at most RUN entries of a non-empty array."""
    last = F.floor((F.size(values) - 1) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: body(F.slice(values, b * RUN + 1, RUN)))


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each entry of a non-empty array of ints, the total of those before it
    (0 for the first). ``plus`` is associative, 0 leaves it unchanged. An
    accumulated array is copied at every step, so totals are taken inside short
    stretches and over the stretches."""

    def short(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(items, start, lambda acc, x: F.struct(
            plus(acc["total"], x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")
        ))

    def whole(stretches: Column) -> Column:
        before = short(F.transform(stretches, lambda s: s["total"]))["before"]
        return F.flatten(
            F.zip_with(stretches, before, lambda s, so_far: F.transform(s["before"], lambda x: plus(so_far, x)))
        )

    return let(values, lambda v: let(blocks_of(v, short), whole))


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
