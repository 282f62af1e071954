"""Usage of records: counts per record and day, decayed with time, that lift often used records in a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE_DIGITS = 9


def daily_usage(events: DataFrame) -> DataFrame:
    """(day, id, n) of events with `ts` and the `id` of the record they used; events without either do not count."""
    sound = events.where("ts IS NOT NULL AND id IS NOT NULL")
    return sound.groupBy(F.to_date("ts").alias("day"), "id").agg(F.count("*").alias("n"))


def decayed_usage(daily: DataFrame, as_of: Column, half_life_days: float = 7.0) -> DataFrame:
    """(id, usage): uses up to the day `as_of`, each counting half after `half_life_days`."""
    age = F.datediff(as_of, F.col("day"))
    weight = F.col("n") * F.pow(F.lit(2.0), -age / F.lit(half_life_days))
    return daily.where(age >= 0).groupBy("id").agg(F.sum(weight).alias("usage"))


def rerank(hits: DataFrame, usage: DataFrame, k: int, boost: float = 0.1) -> DataFrame:
    """(query_id, rank, id, score, usage): the k best hits when use counts too, ties by id.

    A positive score is multiplied by 1 + boost * ln(1 + usage), a negative one divided by it. `hits` holds a bounded number of
    rows per query.
    """
    used = hits.select("query_id", "id", "score").join(usage, "id", "left").withColumn("usage", F.coalesce("usage", F.lit(0.0)))
    factor = 1 + F.lit(boost) * F.log1p("usage")
    lifted = used.withColumn("score", F.when(F.col("score") < 0, F.col("score") / factor).otherwise(F.col("score") * factor))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE_DIGITS)), "id")
    ranked = lifted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score", "usage")
