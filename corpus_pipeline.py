"""A corpus pipeline over ``documents``: toxicity, language, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), calls one operator of ``corpusmill.llm`` and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Models are learned from the stage's own input: toxicity from its labelled rows, language from its rows with a
language. Null and empty texts are not toxic; the language stage rejects them, having no letter. Extra columns
pass through, whatever their names; repeated rows count as copies; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import language, packing, simhash, toxicity
from corpusmill.session import materialize

END_ID = 1


def _judged(docs: DataFrame) -> DataFrame:
    """The rows with their columns packed away, beside the text, so that added columns cannot clash."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the network calls toxic."""
    network = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.judge(_judged(docs), network).where("predicted = 0").select("_row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter and those too far from every language."""
    model = language.learn(docs)
    return language.identify(_judged(docs), model).where("not rejected").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked over fingerprints of three-word shingles at two differing bits or fewer."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids; one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("simhash", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Learned models, fingerprints and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
