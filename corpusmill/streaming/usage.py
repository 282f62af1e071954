"""Usage counts from a stream of events, kept as keyed state until the watermark has passed a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DAILY = "day date, id string, n long, batch long"


def usage_stream(events: DataFrame, location: str, checkpoint: str, lateness: str = "2 days") -> StreamingQuery:
    """Count a stream of (ts, id) per record and day into `location`; stops when what is there has been read.

    Counts are aggregation state keyed by day and id. A day's state goes once the watermark, `lateness` behind the newest event, has
    passed its end, and later events of that day are dropped. Every batch writes the counts it changed to a folder
    of its own; one that is delivered again after a failure writes the same folder again.
    """
    sound = events.where("ts IS NOT NULL AND id IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("string").alias("id"))
    day = F.window("ts", "1 day").alias("day")
    counts = sound.withWatermark("ts", lateness).groupBy(day, "id").agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.to_date("day.start").alias("day"), "id", "n")
        rows.write.mode("overwrite").parquet(f"{location}/batch={number}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def streamed_usage(spark: SparkSession, location: str) -> DataFrame:
    """(day, id, n) as counted so far: counts only grow, so the largest of a key is the newest."""
    rows = spark.read.schema(DAILY).parquet(location)
    return rows.groupBy("day", "id").agg(F.max("n").alias("n"))
