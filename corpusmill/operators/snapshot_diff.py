"""What became of each record from one snapshot to the next.

Records are matched in stages: by id, then what is left by body, then by name. Where several share a body or a name,
they are paired in the order of their ids, one to one. Places inside such a group come from a range sort, so a body
that a third of all records share is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.arrivals import number_in_order
from corpusmill.session import materialize

COMPARED = ["name", "description", "content_hash", "source", "source_id", "category", "tags"]


def _placed(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, with their place among those of the same key, by id."""
    numbered = materialize(number_in_order(rows.where(F.col(key).isNotNull()), key, "id"), "placed")
    first = numbered.groupBy(key).agg(F.min("ord").alias("first"))
    return numbered.join(first, key).withColumn("place", F.col("ord") - F.col("first")).drop("ord", "first")


def _renamed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def _changed() -> Column:
    """The fields that differ, in their fixed order, joined by commas."""
    names = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in COMPARED]
    return F.concat_ws(",", *names).alias("changed")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, old_id, new_id, changed): one row per record of either snapshot.

    unchanged, updated   same id; `changed` lists the fields that differ
    moved                another id, the same body
    rewritten            another id and body, the same name
    removed, new         in one snapshot only

    Ids are unique within a snapshot. A null id, body hash or name matches nothing.
    """
    columns = ["id", *COMPARED]
    old, new = materialize(old.select(*columns), "old"), materialize(new.select(*columns), "new")
    same = _renamed(old, "old_").join(_renamed(new, "new_"), F.col("old_id") == F.col("new_id"))
    rows = same.select("old_id", "new_id", _changed()).select(
        F.when(F.col("changed") == "", "unchanged").otherwise("updated").alias("status"), "old_id", "new_id", "changed"
    )
    left = old.join(new.select("id"), "id", "left_anti"), new.join(old.select("id"), "id", "left_anti")
    for key, status in (("content_hash", "moved"), ("name", "rewritten")):
        sides = [materialize(side, "left") for side in left]
        pairs = materialize(_paired(*sides, key), status)
        rows = rows.unionByName(pairs.select(F.lit(status).alias("status"), "old_id", "new_id", _changed()))
        left = tuple(
            side.join(pairs.select(F.col(name).alias("id")), "id", "left_anti") for side, name in zip(sides, ("old_id", "new_id"), strict=True)
        )
    none = F.lit(None).cast("string")
    gone = left[0].select(F.lit("removed").alias("status"), F.col("id").alias("old_id"), none.alias("new_id"), F.lit("").alias("changed"))
    came = left[1].select(F.lit("new").alias("status"), none.alias("old_id"), F.col("id").alias("new_id"), F.lit("").alias("changed"))
    return rows.unionByName(gone).unionByName(came)


def _paired(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new records of one key side by side, the first with the first and so on."""
    before, after = (_renamed(_placed(side, key), prefix) for side, prefix in ((old, "old_"), (new, "new_")))
    return before.join(after, (F.col(f"old_{key}") == F.col(f"new_{key}")) & (F.col("old_place") == F.col("new_place")))


def diff_summary(rows: DataFrame) -> DataFrame:
    """(status, n_records)."""
    return rows.groupBy("status").agg(F.count("*").alias("n_records"))
