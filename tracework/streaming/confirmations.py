"""Confirmations of worklist rows as an idempotent sink: a batch that comes again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(updates: DataFrame, batch_id: int, path: str) -> None:
    """The updates of a batch as their own partition; only that partition is overwritten."""
    rows = updates.withColumn("batch", F.lit(batch_id).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def confirmations(updates: DataFrame, path: str, checkpoint: str):
    """A running stream of ``updates(row_id, t, event_id, note)`` into ``path``.  A batch that was written but not yet
    committed runs again under its id after a failure, and so leaves no second copy."""
    sink = updates.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, path))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_notes(updates: DataFrame) -> DataFrame:
    """``row_id, note``: the last note of each row; updates that arrive twice count once."""
    return updates.groupBy("row_id").agg(F.max_by("note", F.struct("t", "event_id")).alias("note"))


def confirmed(spark: SparkSession, path: str) -> DataFrame:
    return last_notes(spark.read.parquet(path))
