"""Records as JSON text: tags and metadata as JSON strings, timestamps as ISO-8601."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.schema import conform

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def to_json_columns(corpus: DataFrame) -> DataFrame:
    """The flat text form of a corpus: nested fields become JSON strings."""
    return (
        corpus.withColumn("tags", F.to_json("tags"))
        .withColumn("metadata", F.to_json("metadata"))
        .withColumn("created_at", F.date_format("created_at", ISO_FORMAT))
    )


def from_json_columns(flat: DataFrame) -> DataFrame:
    """Back to the corpus schema; absent optional columns take their defaults."""
    kinds = dict(flat.dtypes)
    if kinds.get("tags") == "string":
        flat = flat.withColumn("tags", F.from_json("tags", "array<string>"))
    if kinds.get("metadata") == "string":
        flat = flat.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    if kinds.get("created_at") == "string":
        flat = flat.withColumn("created_at", F.to_timestamp("created_at"))
    return conform(flat)


def to_documents(corpus: DataFrame) -> DataFrame:
    """One JSON document per record, keyed by id."""
    return corpus.select("id", F.to_json(F.struct(*corpus.columns)).alias("document"))
