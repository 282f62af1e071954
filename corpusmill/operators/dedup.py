"""Duplicate removal by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.arrivals import winners
from corpusmill.session import broadcast_if_small, materialize


def keep_winners(records: DataFrame) -> DataFrame:
    """The surviving records. `ord` is unique, so the join has no hot key.

    The losers are few as a rule: bodies stay where they are when the losers' keys fit a broadcast.
    """
    slim = materialize(records.select("ord", "content_hash", "source"), "arrivals")
    lost = materialize(slim.select("ord").join(winners(slim).select("ord"), "ord", "left_anti"), "losers")
    return records.join(broadcast_if_small(lost), "ord", "left_anti")


def losers(records: DataFrame) -> DataFrame:
    """Ids of the records another copy displaces: all but the winner of each hash."""
    # Joined on the unique `ord`, not on the hash, which may be one third of all records.
    return records.select("id", "ord").join(winners(records).select("ord"), "ord", "left_anti").select("id")


def dedup_report(records: DataFrame) -> DataFrame:
    """One row: records before, after and removed."""
    per_hash = winners(records)
    return per_hash.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("before"),
        F.count("*").alias("after"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count("*")).alias("removed"),
    )
