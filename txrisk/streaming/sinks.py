"""Several sinks behind one stream, idempotent by batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchSinks:
    """For ``foreachBatch``: writes a batch to every sink, each a table made from
    the batch by its function, under ``folder``.

    A batch's part of a table lies in a folder named by the batch's number, and
    a commit is written once all parts are there. A batch that comes again after
    its commit changes nothing; one that broke off before it is written anew in
    the same place. Readers see committed batches only, so all sinks show the
    same batches."""

    def __init__(self, folder: str, sinks: Mapping[str, Callable[[DataFrame], DataFrame]]):
        self.folder, self.sinks = folder.rstrip("/"), dict(sinks)

    def _committed(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("batch long").parquet(f"{self.folder}/commits")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = f"{self.folder}/commits"
        spark.createDataFrame([], "batch long").write.mode("append").parquet(commits)  # the folder is there from the start
        if not self._committed(spark).where(F.col("batch") == number).isEmpty():
            return
        held = batch.persist()
        try:
            for name, made in self.sinks.items():
                made(held).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        finally:
            held.unpersist()
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(commits)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The sink's table over all committed batches, with the number of its ``batch``."""
        if name not in self.sinks:
            raise ValueError(f"no sink named {name}")
        committed = self._committed(spark).distinct()
        rows = spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        return rows.withColumn("batch", F.col("batch").cast("long")).join(committed, "batch", "left_semi")
