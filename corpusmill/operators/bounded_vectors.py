"""Exact inner-product top-k that leaves out blocks of vectors which cannot hold a hit.

Every vector belongs to its nearest pivot. With r the largest distance of a pivot's vectors, no product of a query q with
one of them exceeds q·pivot + |q| r, by Cauchy and Schwarz. A query first visits the pivots of the highest bounds until they hold k
vectors; the k-th score found there is its threshold, and only pivots whose bound reaches it are visited in the second
pass. Vectors that lie in clusters leave most pairs out; vectors without any structure leave out none, and cost a
second pass then.

Pivots decide the cost alone, never the result: they come from a bounded sample of `SAMPLE_ROWS` vectors, drawn by hash.
The vectors of one pivot are dealt over as many groups as its rows ask for, so a pivot with a third of all rows is not
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.nearest import TIE_DIGITS, _columns, _score, _vectors, comparable
from corpusmill.session import broadcast_if_small, materialize

SAMPLE_ROWS = 2_048
PIVOTS = 64
GROUP_ROWS = 4_096
# Products are rounded for ties, and sums differ by their order: a bound must miss by more.
MARGIN = 1e-6


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of a sample, each the farthest from those before it."""
    chosen = [0]
    away = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return _vectors(pa.array(np.arange(len(column))), column).matrix


def place(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, embedding, pivot, away): the nearest pivot of each vector and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("embedding"))
            apart = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)[None]
            nearest = apart.argmin(axis=1)
            away = np.linalg.norm(rows - pivots[nearest], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(away)], [*batch.schema.names, "pivot", "away"])

    fields = ", ".join(f"{name} {kind}" for name, kind in vectors.dtypes)
    return vectors.mapInArrow(run, f"{fields}, pivot int, away double")


def _bounds(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(query_id, pivot, bound) for every pivot that has vectors."""
    used = np.flatnonzero(radius >= 0)
    query_type = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("embedding"))
            reach = rows @ pivots[used].T + np.linalg.norm(rows, axis=1)[:, None] * radius[used][None]
            ids = batch.column("query_id").take(pa.array(np.repeat(np.arange(len(rows)), len(used))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(used, len(rows)).astype(np.int32)), pa.array(reach.ravel())], ["query_id", "pivot", "bound"])

    return queries.select("query_id", "embedding").mapInArrow(run, f"query_id {query_type}, pivot int, bound double")


def _visited(placed: DataFrame, queries: DataFrame, visits: DataFrame, sizes: dict[int, int], k: int, schema: str) -> DataFrame:
    """The k best of each group of a pivot's vectors, for the queries that visit it."""
    spark = placed.sparkSession
    asked = {r["pivot"]: r["n"] for r in visits.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    rows = [(p, -(-sizes[p] // GROUP_ROWS), -(-n // GROUP_ROWS)) for p, n in asked.items()]
    if not rows:
        return spark.createDataFrame([], schema)
    # As many rows as there are pivots.
    deal = F.broadcast(spark.createDataFrame(rows, "pivot int, chunks int, blocks int"))

    def number(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = placed.join(deal, "pivot").withColumn("chunk", number("id", "chunks")).withColumn("block", every("blocks"))
    right = visits.join(deal, "pivot").withColumn("block", number("query_id", "blocks")).withColumn("chunk", every("chunks"))
    right = right.select("query_id", "pivot", "chunk", "block").join(queries, "query_id")

    def score(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        if not stored.num_rows or not wanted.num_rows:
            fields = [wanted.schema.field("query_id"), stored.schema.field("id"), pa.field("score", pa.float64())]
            return pa.schema(fields).empty_table()
        near, far = ([t.column(c).combine_chunks() for c in (key, "embedding")] for t, key in ((stored, "id"), (wanted, "query_id")))
        near, far = _vectors(*near), _vectors(*far)
        return pa.Table.from_arrays(_columns(_score(far.matrix, near, k, None), far.ids), ["query_id", "id", "score"])

    keys = ["pivot", "chunk", "block"]
    left, right = left.select("id", "embedding", *keys), right.select("query_id", "embedding", *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def bounded_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The hits of `nearest.vector_topk`, and one row (n_pairs, n_visited) that tells how much was left out."""
    spark = vectors.sparkSession
    vectors = materialize(comparable(vectors.select("id", "embedding")), "vectors")
    queries = materialize(comparable(queries.select("query_id", "embedding")), "queries")
    id_type, query_type = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {query_type}, id {id_type}, score double"
    sample = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    if k < 0:
        raise ValueError("k must not be negative")
    if not len(sample) or k == 0 or queries.isEmpty():
        none = spark.createDataFrame([], f"query_id {query_type}, rank int, id {id_type}, score double")
        return none, spark.createDataFrame([(vectors.count() * queries.count(), 0)], "n_pairs long, n_visited long")
    pivots = choose_pivots(_matrix(sample), n_pivots)
    placed = materialize(place(vectors, pivots), "placed")
    cells = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    sizes, radius = {c["pivot"]: c["n"] for c in cells}, np.full(len(pivots), -1.0)
    for c in cells:
        radius[c["pivot"]] = c["radius"]

    held = F.broadcast(spark.createDataFrame(list(sizes.items()), "pivot int, n long"))
    bounds = materialize(_bounds(queries, pivots, radius), "bounds").join(held, "pivot")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "pivot")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = materialize(bounds.withColumn("before", before), "visits")
    first = ordered.where(F.col("before") < k)
    hits = materialize(_visited(placed, queries, first.select("query_id", "pivot"), sizes, k, schema), "first-hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(best))
    reached = materialize(ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold")), "thresholds")
    later = ordered.where(F.col("before") >= k).join(broadcast_if_small(reached), "query_id", "left")
    later = materialize(later.where(F.coalesce(F.col("bound") >= F.col("threshold") - MARGIN, F.lit(True))), "second-visits")
    more = _visited(placed, queries, later.select("query_id", "pivot"), sizes, k, schema)
    every = hits.unionByName(more).withColumn("score", F.round("score", TIE_DIGITS))
    found = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    visited = first.select("n").unionAll(later.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_visited"))
    pairs = queries.agg((F.count("*") * sum(sizes.values())).alias("n_pairs"))
    # Two one-row frames.
    return found, pairs.join(visited, F.lit(True))
