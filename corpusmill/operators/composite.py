"""Records that refer to other records: which ones each needs, over any number of steps.

A semi-naive fixpoint: every round joins only the pairs found in the round before with the references, and keeps those
not met yet. It takes as many rounds as the longest shortest chain, whatever the size of the corpus. Where every record is
a root, what its needs need is being found as well, so rounds double the depth instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.schema import FULL_RECORD
from corpusmill.session import broadcast_if_small, materialize

# Fixed value: how a body names another record, by its 16-digit id.
REFERENCE = r"\bskill:([0-9a-f]{16})\b"


def references(corpus: DataFrame) -> DataFrame:
    """(id, ref, known): each reference of a body once, and whether the corpus holds that record."""
    named = F.explode(F.array_distinct(F.regexp_extract_all("instructions", F.lit(REFERENCE), 1)))
    found = corpus.select("id", named.alias("ref"))
    held = corpus.select(F.col("id").alias("ref"), F.lit(True).alias("held")).distinct()
    return found.join(held, "ref", "left").select("id", "ref", F.coalesce("held", F.lit(False)).alias("known"))


def dependencies(refs: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth, known): the records each root needs, with the fewest steps to them.

    `refs` holds id, ref and known, `roots` a column id. A root that needs itself over some steps is on a cycle and has a row
    of its own; unknown references have one with known = false. `max_depth` stops after so many steps.
    """
    edges = materialize(refs.select("id", "ref", "known").distinct(), "references")
    if edges.where("id IS NOT NULL").join(roots.select("id").distinct(), "id", "left_anti").isEmpty():
        return _by_doubling(edges.where("id IS NOT NULL"), max_depth)
    steps = edges.select(F.col("id").alias("at"), F.col("ref").alias("id"), "known")
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("at")).distinct()
    found, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = frontier.join(steps, "at").select("root", "id", "known").distinct()
        if found is not None:
            met = met.join(found.select("root", "id"), ["root", "id"], "left_anti")
        fresh = materialize(met.withColumn("depth", F.lit(depth)), f"needed-{depth}")
        if fresh.isEmpty():
            break
        # A frontier that reaches a root again goes no further: what that root needs is being followed already.
        frontier = fresh.where("known AND id <> root").select("root", F.col("id").alias("at"))
        found = fresh if found is None else found.unionByName(fresh)
    if found is None:
        return refs.sparkSession.createDataFrame([], "root string, id string, depth int, known boolean")
    return found.select("root", "id", "depth", "known")


def _by_doubling(edges: DataFrame, max_depth: int | None) -> DataFrame:
    """The dependencies of every record that has references.

    With all pairs of up to `reach` steps known, a pair of more steps, up to twice as many, has a record at exactly `reach` steps on
    its shortest way. Joining those with what they need gives the pairs of all these depths at once.
    """
    found = edges.select(F.col("id").alias("root"), F.col("ref").alias("id"), F.lit(1).alias("depth"), "known")
    if max_depth is not None and max_depth < 1:
        return found.limit(0)
    reach = 1
    while max_depth is None or reach < max_depth:
        step = reach if max_depth is None else min(reach, max_depth - reach)
        ends = found.where((F.col("depth") == reach) & F.col("known") & (F.col("id") != F.col("root")))
        ends = ends.select("root", F.col("id").alias("at"))
        onward = found.where(F.col("depth") <= step).select(F.col("root").alias("at"), "id", "depth", "known")
        met = ends.join(onward, "at").groupBy("root", "id")
        met = met.agg((F.min("depth") + reach).alias("depth"), F.max("known").alias("known"))
        fresh = materialize(met.join(found.select("root", "id"), ["root", "id"], "left_anti"), f"needed-{reach + step}")
        if fresh.isEmpty():
            break
        found, reach = found.unionByName(fresh), reach + step
    return found.select("root", "id", "depth", "known")


def dependency_report(roots: DataFrame, needed: DataFrame) -> DataFrame:
    """(id, n_needed, n_missing, depth, in_cycle) for every root; depth is that of the farthest record it needs."""
    other = F.col("id") != F.col("root")
    found = needed.groupBy("root").agg(
        F.count_if(F.col("known") & other).alias("n_needed"),
        F.count_if(~F.col("known")).alias("n_missing"),
        F.max(F.when(other, F.col("depth"))).alias("depth"),
        F.max(~other).alias("in_cycle"),
    )
    report = roots.select("id").distinct().join(found.withColumnRenamed("root", "id"), "id", "left")
    filled = {"n_needed": F.lit(0).cast("long"), "n_missing": F.lit(0).cast("long"), "depth": F.lit(0), "in_cycle": F.lit(False)}
    return report.select("id", *[F.coalesce(c, value).alias(c) for c, value in filled.items()])


def fetch_with_dependencies(corpus: DataFrame, requested: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Full records of the requested ids (depth 0) and of all they need, once for each request."""
    wanted = materialize(requested.select("id").distinct(), "requested")
    needed = dependencies(references(corpus), wanted, max_depth).where("known AND id <> root").select("root", "id", "depth")
    asked = wanted.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    return corpus.select(*FULL_RECORD).join(broadcast_if_small(materialize(asked.unionByName(needed), "needed")), "id")
