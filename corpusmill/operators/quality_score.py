"""A quality score for records from length, tags and source, and a filter on it.

Lengths differ by source, so a record's length counts by where it stands among those of its source: by how many eighths of them it
reaches. The eighths come from a mergeable quantile sketch, one per source and task, exact for sources of up to about
`ACCURACY` records and off by at most 1 / `ACCURACY` of the ranks beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.schema import SOURCE_PRIORITY, source_priority
from corpusmill.session import broadcast_if_small, materialize

EIGHTHS = [n / 8 for n in range(1, 8)]
ACCURACY = 10_000
WEIGHTS = {"length_part": 0.5, "tag_part": 0.2, "source_part": 0.3}
FULL_TAGS = 3


def length_eighths(corpus: DataFrame) -> DataFrame:
    """(source, eighths): the lengths that end each eighth of a source's records but the last."""
    sketch = F.percentile_approx(F.length("instructions"), EIGHTHS, ACCURACY)
    return corpus.groupBy("source").agg(sketch.alias("eighths"))


def with_quality(corpus: DataFrame) -> DataFrame:
    """All columns, and `quality` from 0 to 1.

    length_part   eighths of its source that the body reaches, of seven; an empty body has none
    tag_part      tags, of three at most
    source_part   priority of the source, of the highest
    """
    eighths = broadcast_if_small(materialize(length_eighths(corpus), "eighths"))
    reached = F.size(F.filter("eighths", lambda e: F.length("instructions") >= e))
    parts = {
        "length_part": F.when(F.length("instructions") > 0, reached / len(EIGHTHS)).otherwise(0.0),
        "tag_part": F.least(F.size(F.coalesce("tags", F.array())), F.lit(FULL_TAGS)) / FULL_TAGS,
        "source_part": source_priority(F.col("source")) / max(SOURCE_PRIORITY.values()),
    }
    total = sum((F.lit(WEIGHTS[name]) * part for name, part in parts.items()), F.lit(0.0))
    scored = corpus.join(eighths, "source", "left").withColumn("quality", F.round(total, 6))
    return scored.select(*corpus.columns, "quality")


def of_quality(corpus: DataFrame, least: float) -> DataFrame:
    """The records whose quality is at least so high."""
    return with_quality(corpus).where(F.col("quality") >= least)
