"""Checks a record passes before it may enter the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.schema import MANIFEST, REQUIRED, SOURCE_PRIORITY
from corpusmill.session import batch_keys, broadcast_if_small, fresh_path, materialize

# Offenders an error message spells out; the written table has all.
NAMED = 20


class UnvettedRepositoryError(Exception):
    """A batch holds repositories the licence manifest does not list."""


class UnknownSourceError(ValueError):
    """A batch holds sources outside the closed domain."""


def missing_field() -> Column:
    """Name of the first required field that is null, null when all are present."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])


def unknown_source() -> Column:
    return ~F.coalesce(F.col("source").isin(list(SOURCE_PRIORITY)), F.lit(False))


def _refuse(found: DataFrame, name: str, error: type[Exception], what: str) -> None:
    """Raise if there are rows. All of them are written; the message has their number, their place and the first."""
    location = fresh_path(found.sparkSession, "violations")
    found.write.parquet(location)
    written = found.sparkSession.read.schema(found.schema).parquet(location)
    count = written.count()
    if count:
        first = [str(r[name]) for r in written.select(name).orderBy(name).limit(NAMED).collect()]
        more = "" if count <= NAMED else f", … ({count} in all)"
        raise error(f"{what}: {', '.join(first)}{more}; all of them in {location}")


def source_violations(records: DataFrame) -> DataFrame:
    """Counts per source outside the domain."""
    return records.where(unknown_source()).groupBy("source").agg(F.count("*").alias("n_records"))


def require_known_sources(records: DataFrame) -> None:
    _refuse(source_violations(records), "source", UnknownSourceError, "sources outside the domain")


def id_clashes(stored: DataFrame, batch: DataFrame, small_batch: bool | None = None) -> DataFrame:
    """(id, content_hash) pairs of the batch whose id an earlier, different body already holds.

    Ids carry 32 bits of the content hash, so two bodies of one name can meet. Copies of one record
    share both columns and combine before the shuffle.
    """
    ids = batch_keys(batch, "id", small_batch)
    no_order = F.lit(None).cast(batch.schema["ord"].dataType)
    held = stored.join(ids, "id", "left_semi").select("id", "content_hash", no_order.alias("ord"))
    first = (
        held.unionByName(batch.select("id", "content_hash", "ord"))
        .groupBy("id", "content_hash")
        .agg(F.min("ord").alias("ord"), F.max(F.col("ord").isNull()).alias("held"))
    )
    earliest = F.struct(~F.col("held"), F.col("ord"))
    contested = first.groupBy("id").agg(
        F.min_by("content_hash", earliest).alias("owner"), F.count("*").alias("bodies")
    )
    contested = contested.where("bodies > 1").select("id", "owner")
    return first.where("NOT held").join(contested, "id").where("content_hash <> owner").select("id", "content_hash")


def one_per_record(records: DataFrame) -> tuple[DataFrame, int]:
    """The rows with one of each (id, content_hash), and how many others there were.

    Only rows whose pair repeats are grouped; as a rule there are none. A pair with a null is no repeat of another: the
    gate for required fields turns such rows away.
    """
    pair = ["id", "content_hash"]
    often = materialize(records.dropna(subset=pair).groupBy(*pair).count().where("count > 1"), "repeated")
    others = often.agg(F.sum(F.col("count") - 1).alias("n")).first()["n"] or 0
    if not others:
        return records, 0
    keys = broadcast_if_small(often.select(*pair))
    row = F.struct(*records.columns)
    again = records.join(keys, pair, "left_semi").groupBy(*pair).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return records.join(keys, pair, "left_anti").unionByName(again.select("row.*")), others


def with_reject_reason(batch: DataFrame) -> DataFrame:
    """Adds `reason`: the gate a record fails, null for a sound one."""
    missing = missing_field()
    reason = F.when(missing.isNotNull(), F.concat(F.lit("missing "), missing)).when(
        unknown_source(), F.lit("unknown source")
    )
    return batch.withColumn("reason", reason)


def admit(stored: DataFrame, batch: DataFrame, small_batch: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Split a written batch into records fit for the merge and rejects with their reason."""
    checked = with_reject_reason(batch)
    sound = checked.where("reason IS NULL").drop("reason")
    clashes = materialize(id_clashes(stored, sound.select("id", "content_hash", "ord"), small_batch), "clashes")
    rejects = checked.where("reason IS NOT NULL").select("ord", "id", "name", "source", "reason")
    clashing = sound.join(clashes, ["id", "content_hash"], "left_semi")
    rejects = rejects.unionByName(clashing.select("ord", "id", "name", "source", F.lit("id clash").alias("reason")))
    return sound.join(clashes, ["id", "content_hash"], "left_anti"), rejects


def manifest_frame(spark, manifest: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(manifest, MANIFEST)


def unvetted(slugs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Slugs the manifest does not list."""
    return slugs.select("slug").distinct().join(broadcast_if_small(manifest.select("slug")), "slug", "left_anti")


def require_vetted(slugs: DataFrame, manifest: DataFrame) -> None:
    """Abort the whole batch, naming the offenders, before anything is written."""
    _refuse(unvetted(slugs, manifest), "slug", UnvettedRepositoryError, "repositories with no vetted licence")
