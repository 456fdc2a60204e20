"""Trend windows over a stream of readings (an extension: the batch operator fed micro-batch by micro-batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import wells


def trend_stream(readings: DataFrame, history: str, target: str, checkpoint: str, size: int = 20) -> StreamingQuery:
    """Keeps the readings in ``history`` and rewrites in ``target`` the windows of the curves that got new ones.

    Windows are counted in rows, and late readings move them, so a batch reads the whole history of its curves,
    pruned by a semi join, and replaces theirs only.  A batch run again writes the same.
    """
    spark = readings.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        touched = batch.select("curve_id").distinct()
        samples = spark.read.parquet(history).drop("batch").join(touched, "curve_id", "left_semi")
        wells.trend_windows(samples, size).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return readings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, target: str) -> DataFrame:
    """The windows of each curve as of the last batch that touched it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    x = spark.read.parquet(target)
    return x.withColumn("__b", F.max("batch").over(Window.partitionBy("curve_id"))).filter("batch = __b").drop("__b", "batch")
