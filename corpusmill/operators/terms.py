"""A sorted dictionary of terms, and prefixes as ranges of it.

Terms and the two ends of every prefix are sorted together once. A prefix then stands for the terms numbered between its
ends, whatever its length, and is joined with them over blocks of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.arrivals import number_in_order
from corpusmill.session import materialize

# Sorts behind every character that a token can hold.
LAST = "\U0010ffff"
BLOCK = 1024


def distinct_terms(postings: DataFrame) -> DataFrame:
    """(term) of a postings table, each once."""
    return postings.where("words = 1").select(F.col("gram").alias("term")).distinct()


def prefix_terms(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, term) for every term that begins with a prefix; `terms(term)` and `prefixes(prefix)` hold each once."""
    # The last end is not that of the last prefix, where that one begins with another.
    ends = prefixes.agg(F.min("prefix").alias("low"), F.max(F.concat("prefix", F.lit(LAST))).alias("high")).first()
    if ends["low"] is None:
        return prefixes.sparkSession.createDataFrame([], "prefix string, term string")
    # A stored dictionary is sorted: its scan skips what no prefix reaches.
    near = terms.where((F.col("term") >= ends["low"]) & (F.col("term") < ends["high"]))
    marks = prefixes.select(
        "prefix",
        F.explode(F.array(F.struct(F.col("prefix").alias("text"), F.lit(0).alias("kind")),
                          F.struct(F.concat("prefix", F.lit(LAST)).alias("text"), F.lit(2).alias("kind")))).alias("m"),
    ).select(F.col("m.text").alias("text"), F.col("m.kind").alias("kind"), "prefix")
    rows = near.select(F.col("term").alias("text"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prefix"))
    placed = materialize(number_in_order(rows.unionByName(marks), "text", "kind"), "term-order")
    numbered = placed.where("kind = 1").select(F.col("text").alias("term"), F.col("ord").alias("term_id"))
    ranges = placed.where("kind <> 1").groupBy("prefix").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
    reach = F.sequence((F.col("low") / BLOCK).cast("long"), (F.col("high") / BLOCK).cast("long"))
    wanted = ranges.select("prefix", "low", "high", F.explode(reach).alias("block"))
    inside = (F.col("term_id") > F.col("low")) & (F.col("term_id") < F.col("high"))
    found = numbered.withColumn("block", (F.col("term_id") / BLOCK).cast("long")).join(wanted, "block").where(inside)
    return found.select("prefix", "term")
