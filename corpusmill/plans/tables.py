"""The given tables seen as corpus, record files, vectors and queries.

Every view covers its whole table. Stored corpus and incoming batch are the documents with and
without a row in `labels`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.identity import with_identity
from corpusmill.schema import SOURCE_PRIORITY
from corpusmill.session import spread
from corpusmill.sources.folders import write_text_files

OWNER = "org"
# The licence manifest of these tables: source folders src0 to src14 are vetted.
VETTED = [(f"{OWNER}/src{n}", "MIT" if n % 2 else "Apache-2.0", list(SOURCE_PRIORITY)[n % 4]) for n in range(15)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number() -> Column:
    return F.substring("source", 4, 9).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as corpus rows with `ord`, `slug` and `doc_id`."""
    names = F.array(*[F.lit(s) for s in SOURCE_PRIORITY])
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc-"), "doc_id").alias("name"),
        F.concat("lang", F.lit(" text from "), "source").alias("description"),
        F.col("text").alias("instructions"),
        F.get(names, source_number() % 4).alias("source"),
        F.concat(F.lit(f"{OWNER}/"), "source").alias("slug"),
        F.concat(F.lit(f"{OWNER}/"), "source", F.lit(":skills/doc-"), "doc_id", F.lit("/SKILL.md")).alias("source_id"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("category"),
        F.array("lang", "source").alias("tags"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("chars"), F.col("n_chars").cast("string")).alias("metadata"),
        F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("created_at"),
    )
    return with_identity(rows)


def labelled(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def unlabelled(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def record_path() -> Column:
    """Grouped, ungrouped and nested layouts, by language."""
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit("/SKILL.md"))
    return (
        F.when(F.col("lang") == "en", F.concat(F.lit("skills/"), name))
        .when(F.col("lang") == "de", F.concat(F.lit("Document Skills/"), F.col("source"), F.lit("/"), name))
        .when(F.col("lang") == "fr", F.concat(F.lit("skills/"), F.col("lang"), F.lit("/"), name))
        .otherwise(name)
    )


def record_text() -> Column:
    """Each document below a front matter block that differs by language.

    English names all fields, German leaves the name out, French leaves the description empty,
    Spanish has no front matter.
    """
    name = F.concat(F.lit("name: doc-"), F.col("doc_id"))
    described = F.concat(F.lit("description: "), F.col("lang"), F.lit(" text from "), F.col("source"))
    tags = F.concat(F.lit("tags: '"), F.col("lang"), F.lit(" , "), F.col("source"), F.lit(",'"))
    block = (
        F.when(F.col("lang") == "en", F.concat_ws("\n", name, described, tags, F.lit("license: ' BSD-3-Clause '")))
        .when(F.col("lang") == "de", F.concat_ws("\n", described, tags))
        .when(F.col("lang") == "fr", F.concat_ws("\n", name, F.lit("description:"), tags))
    )
    fenced = F.concat(F.lit("---\n"), block, F.lit("\n---\n\n"), F.col("text"))
    return F.coalesce(fenced, F.col("text"))


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, location, text) as a scan of record files would give it."""
    rows = documents(spark, sf_dir).select(
        F.concat(F.lit(f"{OWNER}/"), "source", F.lit("/"), record_path()).alias("path"), record_text().alias("text")
    )
    return rows.select("path", F.concat(F.lit("root/"), "path").alias("location"), "text")


def write_record_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """One text file per document below <owner>/<repo>."""
    rows = documents(spark, sf_dir).select(
        F.lit(OWNER).alias("owner"), F.col("source").alias("repo"), record_text().alias("value")
    )
    write_text_files(rows, root, "owner", "repo")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"), f"{sf_dir}/embeddings.parquet")


def corpus_vectors(spark: SparkSession, sf_dir: str, without_label: int | None = None) -> DataFrame:
    """(id, embedding): vectors under the id of the document they share a number with, or one of their own.

    The latter stand for vectors whose record is gone.
    """
    ids = corpus(spark, sf_dir).select("id", F.col("doc_id").alias("vec_id"))
    own = F.coalesce("id", F.concat(F.lit("vec-"), "vec_id")).alias("id")
    rows = embeddings(spark, sf_dir)
    if without_label is not None:
        rows = rows.where(F.col("label") != without_label)
    return rows.join(ids, "vec_id", "left").select(own, "embedding")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    cells = embeddings(spark, sf_dir).select(
        F.col("label").alias("query_id"), F.posexplode("embedding").alias("pos", "x")
    )
    means = cells.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # As many cells per label as the vectors are wide.
    listed = means.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return listed.select("query_id", F.transform("cells", lambda c: c.x).alias("embedding"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage, whole, as a keyword query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def composite_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, its bodies ending with references: up a tree of halved numbers, along a row, or to and fro, by language.

    German bodies also name a record that does not exist.
    """
    rows = corpus(spark, sf_dir)
    number = F.col("doc_id")
    target = (
        F.when(F.col("category").isin("", "de"), F.floor(number / 2))
        .when(F.col("category") == "fr", number + 1)
        .otherwise(number + 1 - 2 * (number % 2))
    )
    targets = rows.select("doc_id", target.alias("target")).where("doc_id <> target")
    names = rows.select(F.col("doc_id").alias("target"), F.col("id").alias("ref"))
    refs = targets.join(names, "target").select("doc_id", F.concat(F.lit("\nskill:"), "ref").alias("line"))
    broken = F.when(F.col("category") == "de", F.lit("\nskill:" + 16 * "0")).otherwise(F.lit(""))
    body = F.concat("instructions", F.coalesce("line", F.lit("")), broken)
    return rows.join(refs, "doc_id", "left").withColumn("instructions", body).drop("line")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, id): views and clicks as uses of the record that user and key of the event number."""
    used = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    number = F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")
    # One row on the right.
    placed = used.join(n, F.lit(True)).select(F.col("ts").cast("timestamp").alias("ts"), (number % F.col("n")).alias("doc_id"))
    return placed.join(corpus(spark, sf_dir).select("doc_id", "id"), "doc_id").select("ts", "id")


def next_snapshot(rows: DataFrame) -> DataFrame:
    """Corpus rows a version later: French ones under the next source, Spanish ones with another body, German ones described anew."""
    names = F.array(*[F.lit(s) for s in SOURCE_PRIORITY])
    following = F.get(names, F.array_position(names, F.col("source")).cast("int") % len(SOURCE_PRIORITY))
    changed = rows.drop("id", "content_hash").withColumns(
        {
            "source": F.when(F.col("category") == "fr", following).otherwise(F.col("source")),
            "instructions": F.when(F.col("category") == "es", F.concat("instructions", F.lit("\nrevised"))).otherwise(F.col("instructions")),
            "description": F.when(F.col("category") == "de", F.concat("description", F.lit(" (revised)"))).otherwise(F.col("description")),
        }
    )
    return with_identity(changed)
