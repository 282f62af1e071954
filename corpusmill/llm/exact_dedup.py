"""Exact duplicates with a heavy-hitter split: digests that many rows share never meet in a shuffle.

Texts are named by their digest. Every task keeps a Misra-Gries summary of the digests it reads; the summaries are added up and
every digest that may belong to a share of ``1 / heavy`` of all rows or more is a candidate. There are at most ``2 * heavy`` candidates, whatever
the input. A second pass verifies them: it counts them exactly and finds the row that stays, with one partial row per candidate and
task. The winners of those that are frequent indeed are broadcast, and their copies are settled where they are read. The remaining
digests are each less than that share of the rows and take the ordinary way: aggregation and join on the digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, materialize

HEAVY = 1_024
#: Counters of a task's summary for each row of 1 / heavy; its counts are short by at most a quarter of that share.
COUNTERS = 4


def merged(names: pa.Array, counts: np.ndarray, limit: int) -> tuple[pa.Array, np.ndarray]:
    """A Misra-Gries summary of at most ``limit`` counters for the given counts of distinct names."""
    if len(names) <= limit:
        return names, counts
    counts = counts - np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1]
    keep = counts > 0
    return names.filter(pa.array(keep)), counts[keep]


def summaries(digests: DataFrame, limit: int) -> DataFrame:
    """(digest, n): the Misra-Gries summary of each task; no count is too high, nor lower than the truth by more than rows / limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = pa.array([], pa.string()), np.zeros(0, np.int64)
        for batch in batches:
            seen = pc.value_counts(pa.concat_arrays([batch.column(0).cast(pa.string())]))
            every = pa.concat_arrays([names, seen.field("values")]).dictionary_encode()
            weights = np.concatenate((counts, seen.field("counts").to_numpy()))
            summed = np.bincount(np.asarray(every.indices), weights=weights, minlength=len(every.dictionary)).astype(np.int64)
            names, counts = merged(every.dictionary, summed, limit)
        if len(names):
            yield pa.RecordBatch.from_arrays([names, pa.array(counts)], ["digest", "n"])

    return digests.select("digest").mapInArrow(run, "digest string, n long")


def unchanged(text: Column) -> Column:
    return text


def _best(rows: DataFrame) -> DataFrame:
    """Size and the row that stays, per digest: the largest id, of repeated ids the last row written."""
    stays = F.max(F.struct("id", "row")).alias("stays")
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), stays).select("digest", "group_size", F.col("stays.id").alias("keep_id"), F.col("stays.row").alias("keep_row"))


def heavy_winners(slim: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Winners of the digests that at least one in ``heavy`` rows share: at most ``heavy`` rows. ``slim`` is a written table (row, id, digest)."""
    n_rows = slim.count()
    counted = summaries(slim, COUNTERS * heavy).groupBy("digest").agg(F.sum("n").alias("n"))
    # No count is short by more than a quarter of the share; counts add up to the rows at most, which bounds the candidates.
    likely = materialize(counted.where(2 * heavy * F.col("n") >= n_rows).select("digest"), "candidates")
    verified = _best(slim.join(F.broadcast(likely), "digest"))
    return materialize(verified.where(heavy * F.col("group_size") >= n_rows), "heavy-winners")


def exact_duplicates(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = unchanged,
    heavy: int = HEAVY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest (sha256 of the normalised text, lowercase hex).

    Of equal texts the row with the largest id stays. Null texts count as empty. A null id is smaller than any other and keep_id is null only
    where all ids of the group are. Of rows that repeat the largest id one stays. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalise(text).cast("binary"), 256).alias("digest"))
    # Numbered when written: a retry of a later stage reads the same numbers.
    slim = materialize(named.withColumn("row", F.monotonically_increasing_id()), "digests")
    often = heavy_winners(slim, heavy)
    settled = slim.join(F.broadcast(often), "digest")
    others = slim.join(F.broadcast(often.select("digest")), "digest", "left_anti")
    found = settled.unionByName(others.join(_best(others), "digest"))
    return found.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def keep_one(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = unchanged,
    heavy: int = HEAVY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; their ids must be unique and not null.

    Only digests and ids are shuffled: texts stay in the tasks that read them, unless the ids to remove are too many to broadcast.
    """
    lost = exact_duplicates(docs, normalise, heavy, id_col, text_col).where("NOT kept").select(F.col("id").alias(id_col))
    return docs.join(broadcast_if_small(materialize(lost, "copies")), id_col, "left_anti")
