"""Corpus snapshots other installations publish, as Parquet or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.functions.record_json import from_json_columns, to_json_columns
from corpusmill.schema import CORPUS

JSON_SCHEMA = ", ".join(f"{f.name} string" for f in CORPUS.fields)


def read_snapshot(spark: SparkSession, location: str, kind: str = "parquet") -> DataFrame:
    """A snapshot with the corpus schema; absent optional fields take their defaults."""
    if kind == "json":
        # Read as text fields: nested values arrive as their JSON text whether quoted or not.
        return from_json_columns(spark.read.schema(JSON_SCHEMA).json(location))
    return from_json_columns(spark.read.parquet(location))


def write_snapshot(corpus: DataFrame, location: str, kind: str = "parquet") -> None:
    if kind == "json":
        to_json_columns(corpus).write.json(location)
    else:
        corpus.write.parquet(location)
