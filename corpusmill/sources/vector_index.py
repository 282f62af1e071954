"""The stored vector index: versioned vectors, their dimension and the encoder they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.encoders import Encoder, encode
from corpusmill.functions.identity import EMBEDDED_BODY_CHARS, embedding_text
from corpusmill.schema import INDEX_META, VECTORS
from corpusmill.session import materialize
from corpusmill.sources.folders import exists
from corpusmill.sources.versions import DONE, VersionedTable


class EncoderMismatchError(Exception):
    """The index was built with another encoder than the one asked for."""


class DimensionError(ValueError):
    """Vectors of differing or unexpected length."""


def published_location(root: str, backend: str, model: str) -> str:
    """Where a publisher keeps the index of one encoder."""
    return f"{root.rstrip('/')}/{backend}/{model}"


def embedded_texts(corpus: DataFrame, body_chars: int | None = EMBEDDED_BODY_CHARS) -> DataFrame:
    """(id, text, text_hash): what each record's vector is computed from; `body_chars=None` takes whole bodies."""
    text = embedding_text(F.col("name"), F.col("description"), F.col("instructions"), body_chars)
    return corpus.select("id", text.alias("text")).withColumn("text_hash", F.md5("text"))


def dimension_report(vectors: DataFrame) -> DataFrame:
    """One row: vectors, shortest and longest length, whether they agree."""
    size = F.size("embedding")
    return vectors.agg(
        F.count("*").alias("n_vectors"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim")
    ).withColumn("consistent", F.col("min_dim") == F.col("max_dim"))


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.vectors = VersionedTable(spark, f"{self.root}/vectors", VECTORS)

    def _meta_location(self) -> str:
        return f"{self.root}/meta/base={self.vectors.base()}"

    def exists(self) -> bool:
        return self.vectors.exists() and exists(self.spark, f"{self._meta_location()}/{DONE}")

    def read(self) -> DataFrame:
        return self.vectors.read()

    def meta(self) -> dict:
        """Dimension and encoder; an index without encoder information reports an empty one."""
        row = self.spark.read.schema(INDEX_META).json(self._meta_location()).first()
        return {"dimension": row["dimension"], "embedding": dict(row["embedding"] or {})}

    def save(self, vectors: DataFrame, info: dict[str, str]) -> None:
        """Store vectors as a new base; the index counts as present once its description is written."""
        self.vectors.replace(vectors)
        shape = dimension_report(self.vectors.read()).first()
        if shape["n_vectors"] and not shape["consistent"]:
            self.vectors.retire()
            raise DimensionError(f"vector lengths run from {shape['min_dim']} to {shape['max_dim']}")
        self._describe(shape["max_dim"], info)

    def _describe(self, dimension: int | None, info: dict[str, str] | None) -> None:
        meta = self.spark.createDataFrame([(dimension, info)], INDEX_META)
        meta.coalesce(1).write.mode("overwrite").json(self._meta_location())

    def append(self, vectors: DataFrame, removed: DataFrame | None = None) -> None:
        """Add vectors of the index's dimension, which the first ones of an empty index set, and take out ids."""
        vectors = materialize(vectors, "encoded")
        shape, held = dimension_report(vectors).first(), self.meta()
        if shape["n_vectors"]:
            expected = held["dimension"] or shape["max_dim"]
            if not shape["consistent"] or shape["max_dim"] != expected:
                raise DimensionError(f"vector lengths run from {shape['min_dim']} to {shape['max_dim']}, not {expected}")
            if held["dimension"] is None:
                self._describe(expected, held["embedding"] or None)
        self.vectors.append(vectors, removed)

    def require(self, encoder: Encoder) -> None:
        held = self.meta()["embedding"]
        if held != encoder.info:
            raise EncoderMismatchError(f"index holds {held}, asked for {encoder.info}; force a rebuild to switch")

    def build(self, corpus: DataFrame, encoder: Encoder) -> int:
        """Encode the whole corpus into a new base."""
        texts = embedded_texts(corpus)
        self.save(encode(texts, F.col("text"), encoder), encoder.info)
        return self.read().count()

    def update(self, corpus: DataFrame, encoder: Encoder) -> dict[str, int]:
        """Bring the index in step with the corpus: encode what is new or changed, drop what is gone.

        Equal to a rebuild, at the cost of the difference.
        """
        self.require(encoder)
        held = self.read().select("id", "text_hash")
        texts = embedded_texts(corpus)
        current = texts.select("id", "text_hash")
        fresh = materialize(texts.join(held, ["id", "text_hash"], "left_anti"), "unindexed")
        gone = materialize(held.join(current, ["id", "text_hash"], "left_anti").select("id"), "outdated")
        counts = {"added": fresh.count(), "removed": gone.count()}
        if counts["added"] or counts["removed"]:
            encoded = encode(fresh, F.col("text"), encoder)
            self.append(encoded, gone if counts["removed"] else None)
        return counts

    def apply(self, rows: DataFrame, removed: DataFrame | None, encoder: Encoder) -> None:
        """Index one batch of records and take out ids, without looking at the rest of the corpus."""
        self.require(encoder)
        texts = embedded_texts(rows)
        gone = texts.select("id") if removed is None else removed.select("id").unionByName(texts.select("id"))
        self.append(encode(texts, F.col("text"), encoder), gone)

    def adopt(self, published: VectorIndex, encoder: Encoder) -> None:
        """Take over a published index after checking that its encoder, if it names one, is the one asked for."""
        if not published.exists():
            raise FileNotFoundError(f"no published index at {published.root}")
        if published.meta()["embedding"]:
            published.require(encoder)
        self.save(published.read(), encoder.info)
