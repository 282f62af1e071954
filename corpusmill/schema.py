"""Table schemas and the fixed values the corpus is defined by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed source domain and its priorities (higher wins).
SOURCE_PRIORITY = {"anthropic": 4, "community": 3, "langskills": 2, "skillnet": 1}
UNKNOWN_PRIORITY = 0

# Fixed value: the name every record file carries.
RECORD_FILE = "SKILL.md"

# The vetted upstream repositories, their licences and sources.
DEFAULT_MANIFEST = [
    ("anthropics/skills", "Apache-2.0", "anthropic"),
    ("google/skills", "Apache-2.0", "community"),
    ("K-Dense-AI/scientific-agent-skills", "MIT", "community"),
    ("mattpocock/skills", "MIT", "community"),
    ("addyosmani/agent-skills", "MIT", "community"),
    ("obra/superpowers", "MIT", "community"),
    ("kepano/obsidian-skills", "MIT", "community"),
]

# The grouping directories the "anthropic" importer recognises.
GROUP_DIRECTORIES = [
    "Creative & Design",
    "Development & Technical",
    "Enterprise & Communication",
    "Document Skills",
]

CORPUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("instructions", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Columns a stored record cannot be without.
REQUIRED = ["id", "name", "description", "instructions", "source", "content_hash", "created_at"]

VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text_hash", T.StringType()),
    ]
)

INDEX_META = T.StructType(
    [
        T.StructField("dimension", T.IntegerType()),
        T.StructField("embedding", T.MapType(T.StringType(), T.StringType())),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        T.StructField("spdx", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

SUMMARY = ["id", "name", "description", "category", "tags"]
FULL_RECORD = ["id", "name", "description", "instructions", "category", "tags", "source"]


def source_priority(source: Column) -> Column:
    """Priority of a source; an unknown one ranks lowest."""
    table = F.create_map(*[F.lit(v) for pair in SOURCE_PRIORITY.items() for v in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(UNKNOWN_PRIORITY))


def conform(records: DataFrame) -> DataFrame:
    """Give any record table the corpus schema, filling optional fields with their defaults."""
    defaults = {
        "source_id": F.lit(""),
        "category": F.lit(""),
        "tags": F.array().cast("array<string>"),
        "metadata": F.create_map().cast("map<string,string>"),
        "created_at": F.current_timestamp(),
    }
    present = set(records.columns)
    columns = []
    for field in CORPUS.fields:
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        columns.append(value.alias(field.name))
    return records.select(*columns)
