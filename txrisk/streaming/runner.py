"""Run a streaming plan over a table replayed in step order (tests, queries).

The table is staged once, in parallel, partitioned by slices of steps (or of
another column that tells when a row arrives). Slices are then appended to the
stream's source folder oldest first, and the query catches up with each
(``trigger(availableNow=True)``) from its checkpoint. All folders lie under the
session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from txrisk.session import scratch_path
from txrisk.streaming.stream import read_stream


#: Batches without data would follow each other for ever where state has timers on the clock.
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def slices(df: DataFrame, chunks: int = 8, by: str = "step") -> Iterator[DataFrame]:
    """``df`` in ``chunks`` slices of the whole numbers ``by``, lowest first; one pass over ``df``."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None:
        yield df.limit(0)
        return
    width = max(1, -(-(high - low + 1) // chunks))
    staged = scratch_path(df.sparkSession, "stream-staged")
    df.withColumn("_slice", F.floor((F.col(by) - low) / width).cast("int")).write.partitionBy("_slice").parquet(staged)
    rows = df.sparkSession.read.parquet(staged)
    for i in range(-(-(high - low + 1) // width)):
        yield rows.where(F.col("_slice") == i).select(df.columns)


def _start(spark: SparkSession, writer: DataStreamWriter, timers: bool) -> StreamingQuery:
    """The started query; it keeps the settings of its start."""
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, before if not timers else "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


def run_to_table(
    spark: SparkSession,
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    chunks: int = 8,
    keys: Sequence[str] = (),
    by: str = "step",
    timers: bool = False,
) -> DataFrame:
    """Replay ``source`` as a stream through ``build`` and return the sink table.

    ``append``: parquet file sink (exactly-once with the checkpoint);
    ``complete``: ``foreachBatch`` overwriting the sink with each new result;
    ``update``: each batch's changed rows are kept with the batch's number, and
    the table holds the latest row of each of ``keys``, open windows included.
    ``by`` is the order of arrival; ``timers`` says that state has timers on the clock."""
    src, sink, checkpoint = (scratch_path(spark, f"stream-{n}") for n in ("src", "sink", "ckpt"))
    for part in slices(source, chunks, by):
        part.write.mode("append").parquet(src)
        out = build(read_stream(spark, src, source.schema))
        writer = out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
        if mode == "append":
            writer = writer.format("parquet").option("path", sink)
        elif mode == "complete":
            writer = writer.foreachBatch(lambda b, _id: b.write.mode("overwrite").parquet(sink))
        else:
            writer = writer.foreachBatch(
                lambda b, n: b.withColumn("_batch", F.lit(n)).write.mode("append").parquet(sink)
            )
        _start(spark, writer, timers).awaitTermination()
    table = spark.read.parquet(sink)
    if mode != "update":
        return table
    values = [c for c in table.columns if c not in (*keys, "_batch")]
    latest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def run_to_sink(
    spark: SparkSession,
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    chunks: int = 8,
    by: str = "step",
) -> list[dict]:
    """Replay ``source`` as a stream through ``build`` into a ``foreachBatch`` sink.
    Returns the counters that ``build`` observes, by batch: {name: row}."""
    observed: list[dict] = []
    src, checkpoint = (scratch_path(spark, f"stream-{n}") for n in ("src", "ckpt"))
    for part in slices(source, chunks, by):
        part.write.mode("append").parquet(src)
        out = build(read_stream(spark, src, source.schema))
        writer = out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.foreachBatch(sink).start()
        query.awaitTermination()
        observed += [p.observedMetrics for p in query.recentProgress if p.observedMetrics]
    return observed
