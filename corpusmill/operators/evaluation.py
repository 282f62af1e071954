"""Measures of a ranking against known relevance, with bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["precision", "reciprocal_rank", "gain"]
# Chances that a Poisson variable of mean 1 is at most 0, 1, 2, …
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) for n in range(9)]


def per_query(judged: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, reciprocal_rank, gain) over the first k hits.

    `judged` holds query_id, rank from 1 and relevant, a boolean; `totals` query_id and n_relevant, how many records are
    relevant at all, for every query that counts. A query without hits measures 0; gain is the discounted gain over
    the best one possible, 0 where nothing is relevant.
    """
    first = judged.where((F.col("rank") <= k) & F.col("relevant"))
    seen = first.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("found")
    )
    best = F.reduce(
        F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)
    )
    rows = totals.join(seen, "query_id", "left")
    possible = F.when(F.col("n_relevant") > 0, best)
    return rows.select(
        "query_id",
        (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("found") / possible, F.lit(0.0)).alias("gain"),
    )


def averages(measured: DataFrame) -> DataFrame:
    """One row: queries and the mean of each measure."""
    return measured.agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in MEASURES])


def poisson_weight(query_id: Column, replicate: Column) -> Column:
    """How often a query counts in a replicate: a Poisson draw of mean 1 that depends on the two alone."""
    draw = F.xxhash64(query_id, replicate).bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    weight = F.lit(len(POISSON))
    for n in range(len(POISSON) - 1, -1, -1):
        weight = F.when(draw < POISSON[n], n).otherwise(weight)
    return weight


def intervals(measured: DataFrame, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """(measure, mean, low, high): the mean of each measure and its bootstrap interval.

    Each replicate weighs the queries by its own Poisson draws; all replicates are sums of one aggregation, of which a task
    sends a row per replicate.
    """
    rows = measured.select("query_id", *MEASURES, F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    # Replicate 0 is the data itself.
    weight = F.when(F.col("replicate") == 0, 1).otherwise(poisson_weight(F.col("query_id"), F.col("replicate")))
    sums = [F.sum(F.col(m) * F.col("w")).alias(m) for m in MEASURES]
    summed = rows.withColumn("w", weight).groupBy("replicate").agg(F.sum("w").alias("w"), *sums)
    means = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(m) / F.nullif("w", F.lit(0))).alias("mean")) for m in MEASURES]))
    long = summed.select("replicate", means.alias("m")).select("replicate", "m.measure", "m.mean")
    drawn = F.when(F.col("replicate") > 0, F.col("mean"))
    return long.groupBy("measure").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("mean"))).alias("mean"),
        F.percentile(drawn, (1 - level) / 2).alias("low"),
        F.percentile(drawn, (1 + level) / 2).alias("high"),
    )
