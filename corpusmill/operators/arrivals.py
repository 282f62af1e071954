"""First arrivals per content hash and priority level.

Both duplicate removal and the priority merge ask, per content hash, which record of which priority
came first. Priorities form a short fixed list, so that question is one hash aggregation with one
`min(ord)` per level. Copies combine before the shuffle: a body shared by a third of all records
costs one row per map task, where a window would sort that third in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.schema import SOURCE_PRIORITY, UNKNOWN_PRIORITY, source_priority
from corpusmill.session import materialize

# monotonically_increasing_id keeps the row number in its low bits, the partition above them.
PARTITION_BITS = 33

LEVELS = sorted({*SOURCE_PRIORITY.values(), UNKNOWN_PRIORITY})


def first_column(level: int) -> str:
    return f"first_{level}"


def first_arrivals(level: Column, ord: Column) -> list[Column]:
    return [F.min(F.when(level == p, ord)).alias(first_column(p)) for p in LEVELS]


def winners(records: DataFrame) -> DataFrame:
    """(content_hash, ord, copies): the highest priority, the earliest on ties."""
    slim = records.select("content_hash", "ord", source_priority(F.col("source")).alias("level"))
    best_first = [F.col(first_column(p)) for p in reversed(LEVELS)]
    return (
        slim.groupBy("content_hash")
        .agg(*first_arrivals(F.col("level"), F.col("ord")), F.count("*").alias("copies"))
        .select("content_hash", F.coalesce(*best_first).alias("ord"), "copies")
    )


def path_order(path: Column) -> Column:
    """A string that sorts paths part by part; it serves as `ord` without sorting anything."""
    return F.translate(path, "/", "\u0001")


def number_in_order(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Add `ord`, 1, 2, 3, … in the order of the keys, without a window over all rows.

    A range sort places the rows; each partition then starts where the earlier ones end. Pass slim
    columns: they are written once so that every row keeps its place.
    """
    placed = materialize(rows.orderBy(*keys).withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("at", PARTITION_BITS))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("at").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    numbered = placed.join(starts, "part").withColumn("ord", F.col("start") + within + 1)
    return numbered.drop("part", "at", "start")
