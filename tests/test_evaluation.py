"""Measures and bootstrap intervals against plain loops."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.operators import evaluation


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(2)
    rows = [(q, r, rng.random() < 0.4) for q in range(30) for r in range(1, rng.randrange(2, 9))]
    totals = [(q, rng.randrange(0, 9)) for q in range(32)]
    return rows, totals


def plain(rows, totals, k):
    out = {}
    for q, n in totals:
        hits = [r for query, r, relevant in rows if query == q and relevant and r <= k]
        best = sum(1 / math.log2(i + 1) for i in range(1, min(n, k) + 1))
        gain = sum(1 / math.log2(r + 1) for r in hits) / best if n and hits else 0.0
        out[q] = (len(hits) / k, 1 / min(hits) if hits else 0.0, gain)
    return out


def _measured(spark, judged, k=5):
    rows, totals = judged
    frames = spark.createDataFrame(rows, "query_id long, rank int, relevant boolean"), spark.createDataFrame(totals, "query_id long, n_relevant long")
    return evaluation.per_query(*frames, k)


def test_measures(spark, judged):
    got = {r.query_id: (r.precision, r.reciprocal_rank, r.gain) for r in _measured(spark, judged).collect()}
    want = plain(*judged, 5)
    assert set(got) == set(want)
    assert all(got[q] == pytest.approx(want[q]) for q in want)


def plain_weight(query, replicate):
    # Hashes chain over the columns: the first one's is the seed of the second.
    first = xxhash.xxh64_intdigest(struct.pack("<q", query), 42)
    draw = (xxhash.xxh64_intdigest(struct.pack("<i", replicate), first) & ((1 << 31) - 1)) / (1 << 31)
    return sum(draw >= p for p in evaluation.POISSON)


def test_intervals_equal_a_plain_bootstrap(spark, judged):
    measured = _measured(spark, judged)
    got = {r.measure: (r["mean"], r.low, r.high) for r in evaluation.intervals(measured, replicates=50, level=0.9).collect()}
    want = plain(*judged, 5)
    queries = sorted(want)
    weights = np.array([[plain_weight(q, b) for q in queries] for b in range(1, 51)])
    for i, measure in enumerate(evaluation.MEASURES):
        values = np.array([want[q][i] for q in queries])
        means = weights @ values / weights.sum(axis=1)
        assert got[measure] == pytest.approx((values.mean(), np.quantile(means, 0.05), np.quantile(means, 0.95)))


def test_weights_are_poisson(spark):
    frame = spark.range(20_000).select(evaluation.poisson_weight(F.col("id"), F.lit(3)).alias("w"))
    row = frame.agg(F.avg("w"), F.var_pop("w")).first()
    assert row[0] == pytest.approx(1, abs=0.03) and row[1] == pytest.approx(1, abs=0.05)


def test_no_queries(spark):
    frames = spark.createDataFrame([], "query_id long, rank int, relevant boolean"), spark.createDataFrame([], "query_id long, n_relevant long")
    assert evaluation.averages(evaluation.per_query(*frames, 5)).first()["n_queries"] == 0
