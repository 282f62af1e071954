"""Counts, filters, point lookups and deletes over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.schema import FULL_RECORD, SUMMARY
from corpusmill.session import broadcast_if_small

NOT_FOUND = "record not found"


def record_count(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n_records"))


def labelled(corpus: DataFrame) -> DataFrame:
    """Records with a category; the empty string means unlabelled."""
    return corpus.where(F.col("category") != "")


def category_counts(corpus: DataFrame) -> DataFrame:
    counts = labelled(corpus).groupBy("category").agg(F.count("*").alias("n_records"))
    return counts.orderBy(F.desc("n_records"), "category")


def categories(corpus: DataFrame) -> DataFrame:
    return labelled(corpus).select("category").distinct()


def by_category(corpus: DataFrame, category: str) -> DataFrame:
    return corpus.where(F.col("category") == category)


def all_ids(corpus: DataFrame) -> DataFrame:
    return corpus.select("id")


def summaries(corpus: DataFrame) -> DataFrame:
    """The short form of a record: everything but the body."""
    return corpus.select(*SUMMARY)


def fetch_by_id(corpus: DataFrame, requested: DataFrame) -> DataFrame:
    """Full records for a table of requested ids; an unknown id gets a row with `error` set."""
    wanted = requested.select("id").distinct()
    found = corpus.select(*FULL_RECORD).join(broadcast_if_small(wanted), "id", "left_semi")
    # The right side now holds requested rows only, so bodies not asked for never shuffle.
    record = found.withColumn("found", F.lit(True))
    return (
        requested.join(record, "id", "left")
        .withColumn("error", F.when(F.col("found").isNull(), F.lit(NOT_FOUND)))
        .drop("found")
    )


def delete_by_id(corpus: DataFrame, doomed: DataFrame) -> DataFrame:
    return corpus.join(broadcast_if_small(doomed.select("id").distinct()), "id", "left_anti")


def deleted_ids(corpus: DataFrame, doomed: DataFrame) -> DataFrame:
    """The requested ids that exist: those a delete would touch."""
    return corpus.select("id").join(broadcast_if_small(doomed.select("id").distinct()), "id", "left_semi")
