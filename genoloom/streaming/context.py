"""Structured Streaming: windowed counts of memberships by context with a bound on lateness.

An extension: the batch library this engine covers has no streaming operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, context, n, total of tumbling windows; rows later than the watermark are left out."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("context"))
    return df.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "context", "n", "total")


def run_once(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; results go to Parquet exactly once."""
    query = counts.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_updates(counts: DataFrame, path: str) -> DataFrame:
    """Process everything that is there in update mode and return the latest row of every window and context.

    A batch appends only the windows that it changed, and the watermark lets go of the state of
    windows that no row can reach any more, so state is bounded by the lateness, not by the stream.
    A batch that is run again writes the same rows under the same number.
    """
    spark = counts.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", path + "-state").trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct("n", "total"), "batch").alias("x")
    return rows.groupBy("start", "context").agg(last).select("start", "context", "x.n", "x.total")
