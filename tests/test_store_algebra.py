import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, drift, gates, lookup, merge
from corpusmill.operators.arrivals import number_in_order
from corpusmill.schema import SOURCE_PRIORITY
from corpusmill.session import materialize

SOURCES = [*SOURCE_PRIORITY, "elsewhere"]


def sequential(stored, batch):
    """The merge rule one record at a time: {hash: (priority, id)}, outcome per record."""
    held = {h: (SOURCE_PRIORITY.get(s, 0), i) for i, h, s in stored}
    outcomes = []
    for ident, content, source in batch:
        level = SOURCE_PRIORITY.get(source, 0)
        if content not in held:
            outcomes.append("added")
        elif level > held[content][0]:
            outcomes.append("replaced")
        else:
            outcomes.append("skipped")
            continue
        held[content] = (level, ident)
    return held, outcomes


@pytest.mark.parametrize("seed", range(4))
def test_merge_matches_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    hashes = [f"h{i}" for i in range(25)]
    # One body holds a third of the batch.
    pick = lambda: "h0" if rng.random() < 0.34 else rng.choice(hashes)
    stored = [(f"s{h}", h, rng.choice(SOURCES)) for h in rng.sample(hashes, 10)]
    batch = [(f"b{i}", pick(), rng.choice(SOURCES)) for i in range(300)]
    held, expected = sequential(stored, batch)
    schema = "id string, content_hash string, source string"
    stored_df = spark.createDataFrame(stored, schema)
    batch_df = spark.createDataFrame([(i, *r) for i, r in enumerate(batch)], f"ord long, {schema}")
    outcomes = materialize(merge.hash_outcomes(stored_df, batch_df), "test")
    rows = merge.classify(batch_df, outcomes).orderBy("ord").collect()
    assert [r.outcome for r in rows] == expected
    counts = merge.merge_stats(outcomes).first()
    assert counts.total == 300
    assert (counts.added, counts.replaced) == (expected.count("added"), expected.count("replaced"))
    assert counts.skipped_duplicate == expected.count("skipped")
    merged = merge.merge_corpus(stored_df, batch_df).collect()
    assert {r.content_hash: r.id for r in merged} == {h: i for h, (_, i) in held.items()}
    assert len(merged) == len(held)


def test_merge_without_broadcast_gives_the_same(spark):
    schema = "id string, content_hash string, source string"
    stored = spark.createDataFrame([("a", "h", "skillnet")], schema)
    batch = spark.createDataFrame([(0, "b", "h", "anthropic"), (1, "c", "g", "skillnet")], f"ord long, {schema}")
    small = merge.merge_stats(merge.hash_outcomes(stored, batch, True)).first()
    large = merge.merge_stats(merge.hash_outcomes(stored, batch, False)).first()
    assert small == large
    assert (small.added, small.replaced) == (1, 1)


def test_dedup_keeps_priority_then_first(spark, make_corpus):
    rows = [
        ("s1", "d", "same", "langskills"),
        ("s2", "d", "same", "anthropic"),
        ("s3", "d", "same", "anthropic"),
        ("s4", "d", "own", "community"),
    ]
    corpus = make_corpus(rows, ordered=True)
    assert {r.name for r in dedup.keep_winners(corpus).collect()} == {"s2", "s4"}
    gone = dedup.losers(corpus).join(corpus, "id").collect()
    assert {r.name for r in gone} == {"s1", "s3"}
    report = dedup.dedup_report(corpus).first()
    assert (report.before, report.after, report.removed) == (4, 2, 2)


def test_empty_bodies_share_one_hash(make_corpus):
    corpus = make_corpus([("a", "d", "", "community"), ("b", "d", "", "community")], ordered=True)
    assert [r.name for r in dedup.keep_winners(corpus).collect()] == ["a"]


def test_gates(spark, make_corpus):
    corpus = make_corpus(
        [("a", "d", "i1", "community"), ("b", None, "i2", "community"), ("c", "d", "i3", "nowhere")], ordered=True
    )
    reasons = {r.name: r.reason for r in gates.with_reject_reason(corpus).collect()}
    assert reasons == {"a": None, "b": "missing description", "c": "unknown source"}
    with pytest.raises(gates.UnknownSourceError, match="nowhere"):
        gates.require_known_sources(corpus)
    slugs = spark.createDataFrame([("z/z",), ("google/skills",), ("a/b",)], "slug string")
    manifest = gates.manifest_frame(spark, [("google/skills", "Apache-2.0", "community")])
    with pytest.raises(gates.UnvettedRepositoryError, match="a/b, z/z"):
        gates.require_vetted(slugs, manifest)


def test_id_clash_goes_to_the_first_body(spark):
    schema = "id string, content_hash string"
    stored = spark.createDataFrame([("held", "h1")], schema)
    rows = [(0, "held", "h2"), (1, "x", "h3"), (2, "x", "h4"), (3, "x", "h3"), (4, "held", "h1")]
    batch = spark.createDataFrame(rows, f"ord long, {schema}")
    found = {tuple(r) for r in gates.id_clashes(stored, batch).collect()}
    assert found == {("held", "h2"), ("x", "h4")}


def test_lookups(spark, make_corpus):
    corpus = make_corpus([("a", "d", "i1", "community", "x"), ("b", "d", "i2", "community", "y"), ("c", "d", "", "community")])
    assert [tuple(r) for r in lookup.category_counts(corpus).collect()] == [("x", 1), ("y", 1)]
    assert {r.category for r in lookup.categories(corpus).collect()} == {"x", "y"}
    assert lookup.record_count(corpus).first().n_records == 3
    ids = {r.name: r.id for r in corpus.collect()}
    wanted = spark.createDataFrame([(ids["c"],), ("gone",)], "id string")
    rows = {r.id: r for r in lookup.fetch_by_id(corpus, wanted).collect()}
    assert rows[ids["c"]].error is None and rows[ids["c"]].instructions == ""
    assert rows["gone"].error == lookup.NOT_FOUND and rows["gone"].name is None
    assert {r.name for r in lookup.delete_by_id(corpus, wanted).collect()} == {"a", "b"}
    assert lookup.deleted_ids(corpus, wanted).count() == 1
    assert "instructions" not in lookup.summaries(corpus).columns


def test_drift_is_by_id(spark, make_corpus):
    corpus = make_corpus([("a", "d", "i1", "community"), ("b", "d", "i2", "community")])
    first = corpus.where("name = 'a'").select("id")
    vectors = first.unionByName(spark.createDataFrame([("gone",)], "id string"))
    row = drift.index_status(corpus, vectors).first()
    assert tuple(row) == (2, 2, 1, 1, False)
    assert drift.has_stale(corpus, vectors)
    assert not drift.has_stale(corpus, first)


def test_numbering_is_dense_and_ordered(spark):
    values = random.Random(1).sample(range(10_000), 500)
    frame = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    rows = number_in_order(frame, "v").orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(1, 501))
    assert [r.v for r in rows] == sorted(values)
