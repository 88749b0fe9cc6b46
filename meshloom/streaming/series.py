"""Series as streams: the latest file's value per iteration, and residual state per run and field.

The later file must win, so dropping duplicates (which keeps the first) would be wrong. Both operators hold a
bounded value per key as aggregation state, which Spark checkpoints.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import new_folder


def latest_wins(stream: DataFrame) -> DataFrame:
    """run_id, it, value of a stream of run_id, start, line, it, value, in update or complete mode. The state
    is one row per run and iteration, as large as the result."""
    return stream.groupBy("run_id", F.round("it", 9).alias("it")).agg(F.max_by("value", F.struct("start", "line")).alias("value"))


def residual_state(stream: DataFrame, most: float, late: str = "1 hour", every: str = "1 day", time: str = "ts") -> DataFrame:
    """Per run, field and window of event time: number of residuals, the last one, and whether one passed the
    limit. State behind the watermark is dropped; rows later than that are dropped and counted by Spark."""
    w = F.window(time, every)
    return (stream.withWatermark(time, late).groupBy(w.alias("w"), "run_id", "name")
            .agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "event_id").alias("last"), F.max((F.col("value") > most).cast("int")).alias("over"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "run_id", "name", "n", "last", (F.col("over") == 1).alias("over")))


def run_now(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result. In complete mode each batch writes the whole
    result to the shared folder and the last one counts; no row passes the driver."""
    spark: SparkSession = result.sparkSession
    out, last = new_folder(spark, "stream"), {}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last["path"] = f"{out}/{number}"

    q = result.writeStream.outputMode(mode).option("checkpointLocation", new_folder(spark, "state")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(last["path"]) if last else spark.createDataFrame([], result.schema)
