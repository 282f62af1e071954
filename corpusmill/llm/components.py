"""Connected components of a large graph of long node ids, by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins over the edge table, written to the shared folder so
that lineage stays short. A hub costs one partial minimum per map task in the aggregation; in the join its
edges are the skewed side of a sort-merge join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges in, one row (node, root) out for every node that has an edge and is not its own root.

    The root is the smallest node id reachable. Self-loops, repeated and reversed edges are allowed; rows
    with a null end are ignored; no edges give no rows.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = materialize(edges.distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
