"""Content hash, deterministic id and the text an encoder sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDED_BODY_CHARS = 500
ID_HEX_DIGITS = 16
ID_HASH_DIGITS = 8


def content_hash(instructions: Column) -> Column:
    return F.md5(instructions)


def record_id(source: Column, name: Column, hashed: Column) -> Column:
    """First 16 hex digits of sha256 over source, name and 8 digits of the content hash."""
    raw = F.concat(source, F.lit(":"), name, F.lit(":"), F.substring(hashed, 1, ID_HASH_DIGITS))
    return F.substring(F.sha2(raw, 256), 1, ID_HEX_DIGITS)


def embedding_text(
    name: Column, description: Column, instructions: Column, body_chars: int | None = EMBEDDED_BODY_CHARS
) -> Column:
    """Name, description and the opening of the body, all of it with `body_chars=None`; an empty body adds no line."""
    opening = F.when(instructions != "", instructions if body_chars is None else F.substring(instructions, 1, body_chars))
    return F.concat_ws("\n", name, description, opening)


def with_identity(records: DataFrame) -> DataFrame:
    """Add content_hash and id where a record does not already carry them."""
    for column in ("content_hash", "id"):
        if column not in records.columns:
            records = records.withColumn(column, F.lit(None).cast("string"))
    hashed = F.coalesce(F.nullif("content_hash", F.lit("")), content_hash(F.col("instructions")))
    records = records.withColumn("content_hash", hashed)
    computed = record_id(F.col("source"), F.col("name"), F.col("content_hash"))
    return records.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), computed))
