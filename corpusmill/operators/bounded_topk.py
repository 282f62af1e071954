"""The best records of each query by summed gains, exactly, without scoring every pair that matches.

A gain is what one unit of a query (a word, a phrase) adds to the score of one record, before the query's weight. The
gains of a unit lie in blocks of records of about equal length, and every block carries its largest gain. Two passes:

* Threshold. Each query takes the blocks that may add most, up to a fixed multiple of `k` records, scores the best of
  them in full, and has with the k-th score a bound that its hits must reach.
* Blocks. Inside a class of record lengths the units of a query are put in order of their bounds. Those whose bounds
  together stay below the threshold cannot make a hit on their own; a hit holds one of the others, its leads. A whole
  class whose bounds do not add up is left out. The gains are dealt by record once, so that one aggregation of a task sums
  each pair of its records, and pairs without a lead or below the threshold end there: no pair is shuffled.

A query that needs all its units takes its candidates from its rarest unit instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, is_small, materialize

CLASSES_PER_OCTAVE = 4
# Records, times k, whose postings a query reads for its threshold, and those of them that it scores.
SEED_POSTINGS = 100
SEEDS = 8
# Pairs of query and record that one task may hold sums of.
TASK_PAIRS = 1_000_000
# Sums of floating-point gains may differ by their order; a bound must miss by more.
MARGIN = 1e-6
# What a unit is to a pair; the greatest of them decides.
FOLLOWS, LEADS, BARS = 0, 1, 2


def length_class(n_tokens: Column) -> Column:
    return F.floor(CLASSES_PER_OCTAVE * F.log2(n_tokens + 1.0)).cast("int")


def blocks(gains: DataFrame) -> DataFrame:
    """(unit, class, top, n): the largest gain and the records of each block of `gains(unit, id, class, gain)`."""
    return gains.groupBy("unit", "class").agg(F.max("gain").alias("top"), F.count("*").alias("n"))


def _by_record(gains: DataFrame, n_pairs: int) -> DataFrame:
    """The gains dealt by record: sums per query and record need no other shuffle, and pairs fit the memory of a task."""
    parts = max(gains.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // TASK_PAIRS))
    return gains.repartition(parts, "id")


def _summed(met: DataFrame) -> DataFrame:
    """(query_id, id, score, present, needed) of the records that hold none of their query's negated units."""
    summed = met.groupBy("query_id", "id").agg(
        F.sum(F.when(~F.col("negated"), F.col("weight") * F.col("gain"))).alias("score"),
        F.count_if(~F.col("negated")).alias("present"),
        F.max("negated").alias("barred"),
        F.max("needed").alias("needed"),
    )
    return summed.where("NOT barred AND present > 0").drop("barred")


def scored(pairs: DataFrame, gains: DataFrame, plan: DataFrame, n_pairs: int) -> DataFrame:
    """(query_id, id, score, present, needed) of the pairs whose record holds none of the query's negated units.

    Gains meet the records of the pairs first: what no pair asks for ends there, before it is multiplied by the queries of its
    unit. Pairs beyond a broadcast are met after the sums, one row each, not once for every unit. `n_pairs` bounds how many
    pairs there can be.
    """
    wanted = materialize(pairs.select("query_id", "id").distinct(), "pairs")
    units = broadcast_if_small(plan.select("query_id", "unit", "negated", "weight", "needed"))
    slim = gains.select("unit", "id", "gain")
    if is_small(wanted):
        return _summed(slim.join(F.broadcast(wanted), "id").join(units, ["query_id", "unit"]))
    return _summed(_by_record(slim, n_pairs).join(units, "unit")).join(wanted, ["query_id", "id"], "left_semi")


def thresholds(gains: DataFrame, bounds: DataFrame, plan: DataFrame, k: int, n_pairs: int) -> DataFrame:
    """(query_id, threshold): a score that k records of the query are known to reach; 0 where fewer are known."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "unit", "class")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = bounds.withColumn("before", before).where(F.col("before") < SEED_POSTINGS * k)
    first = materialize(first.select("query_id", "unit", "class", "weight"), "seed-blocks")
    sums = gains.join(broadcast_if_small(first), ["unit", "class"]).groupBy("query_id", "id")
    sums = sums.agg(F.sum(F.col("weight") * F.col("gain")).alias("part"))
    best = Window.partitionBy("query_id").orderBy(F.desc("part"), "id")
    seeds = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SEEDS * k).select("query_id", "id")
    # At most SEEDS * k scores of a query.
    scores = F.sort_array(F.collect_list("score"), asc=False)
    reached = scored(seeds, gains, plan, n_pairs).groupBy("query_id").agg(F.get(scores, F.lit(k - 1)).alias("threshold"))
    return reached.select("query_id", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def leads(bounds: DataFrame, reached: DataFrame) -> DataFrame:
    """(query_id, unit, class, lead, threshold): the units of each query in the length classes that may hold a hit.

    `lead` marks the units one of which a hit of that class must hold: the bounds of the others stay below the threshold.
    """
    known = bounds.join(broadcast_if_small(materialize(reached, "thresholds")), "query_id", "left")
    known = known.withColumn("threshold", F.coalesce("threshold", F.lit(0.0)) - MARGIN)
    inside = Window.partitionBy("query_id", "class").orderBy("bound", "unit")
    upto = F.sum("bound").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lead = known.withColumn("lead", upto >= F.col("threshold"))
    open_class = F.max("lead").over(Window.partitionBy("query_id", "class"))
    return lead.withColumn("open", open_class).where("open").select("query_id", "unit", "class", "lead", "threshold")


def likely(gains: DataFrame, plan: DataFrame, k: int, n_pairs: int) -> DataFrame:
    """(query_id, id, score): every pair that is among the k best of its query, and few others."""
    wanted = plan.where("NOT negated").select("query_id", "unit", "weight")
    bounds = blocks(gains).join(broadcast_if_small(wanted), "unit")
    bounds = materialize(bounds.withColumn("bound", F.col("weight") * F.col("top")), "bounds")
    reached = thresholds(gains, bounds, plan, k, n_pairs)
    leading = materialize(leads(bounds, reached), "leads")
    # A negated unit bars a record of any class; it leads nowhere.
    classes = leading.groupBy("query_id", "class").agg(F.max("threshold").alias("threshold"))
    barring = plan.where("negated").select("query_id", "unit").join(classes, "query_id")
    every = leading.unionByName(barring.withColumn("lead", F.lit(False)))
    asked = every.join(broadcast_if_small(plan.select("query_id", "unit", "negated", "weight", "needed")), ["query_id", "unit"])
    # Every pair that matches is summed, so what a sum carries is little: a barring unit adds nothing and outranks a lead.
    kind = F.when(F.col("negated"), BARS).when(F.col("lead"), LEADS).otherwise(FOLLOWS)
    weight = F.when(F.col("negated"), F.lit(0.0)).otherwise(F.col("weight"))
    asked = asked.select("unit", "class", "query_id", weight.alias("weight"), kind.alias("kind"), "threshold")
    asked = broadcast_if_small(materialize(asked, "asked-blocks"))
    met = _by_record(gains.select("unit", "id", "class", "gain"), n_pairs).join(asked, ["unit", "class"])
    found = met.groupBy("query_id", "id").agg(
        F.sum(F.col("weight") * F.col("gain")).alias("score"), F.max("kind").alias("kind"), F.max("threshold").alias("threshold")
    )
    return found.where((F.col("kind") == LEADS) & (F.col("score") >= F.col("threshold"))).select("query_id", "id", "score")


def pairs_with_all(gains: DataFrame, plan: DataFrame) -> DataFrame:
    """(query_id, id): the records of the rarest unit of each query all of whose units occur."""
    rarest = F.min_by("unit", F.struct("n_records", "unit")).alias("unit")
    complete = plan.where("NOT negated").groupBy("query_id").agg(rarest, F.count("*").alias("n"), F.max("needed").alias("needed"))
    chosen = broadcast_if_small(materialize(complete.where("n = needed").select("query_id", "unit"), "rarest"))
    return gains.select("unit", "id").join(chosen, "unit").select("query_id", "id")
