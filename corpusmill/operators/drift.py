"""How far a vector index has moved from the corpus it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_ids(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Corpus ids no vector stands for."""
    return corpus.select("id").join(vectors.select("id"), "id", "left_anti")


def stale_ids(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector ids whose record is gone."""
    return vectors.select("id").join(corpus.select("id"), "id", "left_anti")


def has_stale(corpus: DataFrame, vectors: DataFrame) -> bool:
    return not stale_ids(corpus, vectors).limit(1).isEmpty()


def index_status(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: records, vectors, missing, stale — by id, from one full join of two id columns."""
    held = corpus.select("id", F.lit(1).alias("in_corpus"))
    indexed = vectors.select("id", F.lit(1).alias("in_index"))
    both = held.join(indexed, "id", "full")
    return both.agg(
        F.count("in_corpus").alias("n_records"),
        F.count("in_index").alias("n_vectors"),
        F.count_if(F.col("in_index").isNull()).alias("n_missing"),
        F.count_if(F.col("in_corpus").isNull()).alias("n_stale"),
    ).withColumn("in_step", (F.col("n_missing") + F.col("n_stale")) == 0)
