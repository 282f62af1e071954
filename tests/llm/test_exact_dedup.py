"""Exact duplicates against plain grouping; the summary against exact counts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, kept int, row string"


def plain(rows):
    groups = defaultdict(list)
    for name, text in rows:
        groups[text or ""].append(name)
    out = []
    for text, names in groups.items():
        keep = max((n for n in names if n is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept_left = 1
        for name in sorted(names, key=lambda n: n != keep):
            out.append((name, keep, len(names), name == keep and kept_left > 0, digest))
            kept_left = 0
    return Counter(out)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def _rows(seed, n):
    rng = random.Random(seed)
    rows = [(i, "hot text" if rng.random() < 0.35 else rng.choice(["", None, "A", "a", "a ", f"t{rng.randrange(n)}"])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [1, 4, 1_024])
def test_equals_plain_grouping(spark, heavy):
    rows = _rows(heavy, 400) + [(7, "hot text"), (399, "repeated"), (399, "repeated"), (None, "no id"), (None, "no id"), (None, "hot text"), (5, "x" * 300_000)]
    found = exact_dedup.exact_duplicates(_docs(spark, rows).repartition(5), heavy=heavy)
    got = Counter(tuple(r) for r in found.select("id", "keep_id", "group_size", "kept", "digest").collect())
    assert got == plain(rows)


def test_heavy_digests_do_not_reach_the_shuffle(spark):
    slim = spark.range(3_000).selectExpr("id AS row", "id", "if(id % 3 = 0, 'hot', cast(id % 1500 AS string)) AS digest").repartition(4)
    often = exact_dedup.heavy_winners(exact_dedup.materialize(slim, "slim"), heavy=10).collect()
    assert [(r.digest, r.group_size, r.keep_id) for r in often] == [("hot", 1_000, 2_997)]


def test_normalised_texts(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    got = exact_dedup.exact_duplicates(_docs(spark, rows), normalise=F.lower).where("kept").collect()
    assert sorted(r.id for r in got) == [2, 3]


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")]
    docs = _docs(spark, rows)
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 5]


def test_empty_table(spark):
    docs = _docs(spark, [(1, "a")]).limit(0)
    assert exact_dedup.exact_duplicates(docs).collect() == exact_dedup.keep_one(docs).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_summary_bounds(seed):
    """Counts are never too high, and short by at most rows / limit, over any order of merges."""
    rng, limit = random.Random(seed), 8
    stream = [f"k{min(int(rng.expovariate(0.2)), 60)}" for _ in range(2_000)]
    names, counts = pa.array([], pa.string()), np.zeros(0, np.int64)
    for at in range(0, len(stream), 90):
        part = Counter(stream[at : at + 90])
        every = Counter(dict(zip(names.to_pylist(), counts.tolist(), strict=True))) + part
        names, counts = exact_dedup.merged(pa.array(list(every), pa.string()), np.array(list(every.values())), limit)
        assert len(names) <= limit
    truth = Counter(stream)
    kept = dict(zip(names.to_pylist(), counts.tolist(), strict=True))
    assert all(0 <= truth[k] - kept.get(k, 0) <= len(stream) / limit for k in truth)
