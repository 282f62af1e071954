"""Costs that must not grow faster than the input: what is shuffled, how many rounds and tasks a job takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bounded_topk, composite, nearest
from corpusmill.operators import keyword as kw
from corpusmill.plans import jobs
from corpusmill.session import OPEN_COST, SMALL_FILE_COST, small_files
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.versions import VersionedTable


def exchanges(frame):
    """The lines of the hash exchanges of a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_record_files_share_tasks_whatever_the_session_says(spark):
    before = spark.conf.get(OPEN_COST)
    for cost, inside in (("4194304", SMALL_FILE_COST), ("4MB", SMALL_FILE_COST), ("1024", 1024)):
        spark.conf.set(OPEN_COST, cost)
        with small_files(spark):
            assert int(spark.conf.get(OPEN_COST)) == inside
        assert spark.conf.get(OPEN_COST) == cost
    spark.conf.set(OPEN_COST, before)


def test_an_import_shares_out_many_files_in_few_tasks(spark, tmp_path, monkeypatch):
    root, seen = tmp_path / "in", []
    for i in range(100):
        (root / f"r{i}").mkdir(parents=True)
        (root / f"r{i}" / "SKILL.md").write_text(f"---\nname: n{i}\ndescription: d\n---\nbody {i}")
    store, real = CorpusStore(spark, str(tmp_path / "store")), jobs.materialize
    store.init()
    monkeypatch.setattr(jobs, "materialize", lambda df, label: (seen.append(df.sparkSession.conf.get(OPEN_COST)), real(df, label))[1])
    before = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, "4194304")
    try:
        result = jobs.import_files(store, jobs.scan_record_files(spark, str(root)), "directory")
    finally:
        spark.conf.set(OPEN_COST, before)
    assert result.counts["added"] == 100 and seen[0] == str(SMALL_FILE_COST)


def test_sums_per_record_shuffle_text_not_grams(spark, make_corpus):
    rows = make_corpus([(f"n{i}", "some words", f"body {i} of words words", "community") for i in range(20)])
    rows = rows.unionByName(rows.limit(3))
    postings = kw.build_postings(kw.by_record(rows), pairs=False)
    per_record = postings.groupBy("gram", "id").count()
    assert not [line for line in exchanges(per_record) if "gram" in line]
    plain = kw.term_stats(kw.build_postings(rows, pairs=False))
    assert sorted(map(tuple, kw.term_stats(postings).collect())) == sorted(map(tuple, plain.collect()))


def test_many_pairs_are_summed_without_a_shuffle_of_pairs(spark, make_corpus, monkeypatch):
    rows = make_corpus([(f"n{i}", "", " ".join(f"w{j}" for j in range(i % 7, 9)) + f" body{i}", "community") for i in range(60)])
    queries = spark.createDataFrame([(1, "w8 w3 w2"), (2, "w7 w8"), (3, "w1 w5 nowhere")], "query_id long, query string")
    whole = {(m, e): sorted(map(tuple, kw.keyword_search(rows, queries, m, exclude=e and F.lit(e)).collect())) for m in ("any", "all") for e in (None, "w4")}
    assert all(whole[key] for key in (("any", None), ("any", "w4"), ("all", None)))
    monkeypatch.setattr(bounded_topk, "is_small", lambda *_: False)
    for (mode, exclude), hits in whole.items():
        found = kw.keyword_search(rows, queries, mode, exclude=exclude and F.lit(exclude))
        assert sorted(map(tuple, found.collect())) == hits
    found = kw.matched(kw.build_postings(rows, pairs=False), queries, "any", F.lit("w4"), None, 10, False, None)
    assert not [line for line in exchanges(found) if "query_id" in line]


def test_rounds_double_the_depth(spark, monkeypatch):
    refs = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}", i < 39) for i in range(40)], "id string, ref string, known boolean")
    labels, real = [], composite.materialize
    monkeypatch.setattr(composite, "materialize", lambda df, label: (labels.append(label), real(df, label))[1])
    for limit in (None, 11):
        labels.clear()
        found = {tuple(r) for r in composite.dependencies(refs, refs.select("id"), limit).collect()}
        want = {(f"{a:03}", f"{b:03}", b - a, b < 40) for a in range(40) for b in range(a + 1, 41) if limit is None or b - a <= limit}
        assert found == want
        assert len(labels) <= 9


def test_scores_by_folded_maxima(monkeypatch):
    rng = np.random.default_rng(3)
    stored = nearest.Vectors(np.arange(700), np.round(rng.normal(size=(700, 6)), 1))
    asked = np.round(rng.normal(size=(90, 6)), 1)
    monkeypatch.setattr(nearest, "SCORE_CELLS", 9_000)
    products = np.round(asked @ stored.matrix.T, nearest.TIE_DIGITS)
    for k in (1, 5, 699, 700, 900):
        got = nearest._score(asked, stored, k, None)
        for q in range(len(asked)):
            best = np.lexsort((stored.ids, -products[q]))[:k]
            mine = got.row == q
            assert got.id[mine].tolist() == best.tolist() and np.array_equal(got.score[mine], products[q][best])
    # Few cells are rounded: those that may be hits.
    sizes, real = [], np.round
    monkeypatch.setattr(nearest.np, "round", lambda a, *rest: (sizes.append(np.size(a)), real(a, *rest))[1])
    nearest._score(rng.normal(size=(90, 6)), stored, 5, None)
    assert sum(sizes) < 90 * 700 / 4


def test_stored_postings_shuffle_text_not_grams(spark, make_corpus, tmp_path, monkeypatch):
    rows = make_corpus([(f"n{i}", "", f"memory leak number {i} of many leaks", "community") for i in range(20)])
    store, plans, real = CorpusStore(spark, str(tmp_path)), [], VersionedTable._write
    store.records.replace(rows.limit(12))
    monkeypatch.setattr(VersionedTable, "_write", lambda table, frame, at: (plans.append(frame), real(table, frame, at))[1])
    store.rebuild_postings()
    store.records.append(rows.join(store.read().select("id"), "id", "left_anti"))
    assert store.update_postings() == {"added": 8, "removed": 0}
    written = [frame for frame in plans if "gram" in frame.columns]
    assert len(written) == 2 and not [line for frame in written for line in exchanges(frame) if "gram" in line or "bucket" in line]
    # One stored row per token and record: a pair is read off the row of its first word.
    flat = kw.build_postings(rows)
    stored = spark.read.parquet(*[str(p) for p in tmp_path.glob("*postings/base=*/rows/v=*")])
    assert stored.count() == flat.where("words < 2").count()
    names = ["gram", "words", "id", "field", "pos", "n_tokens"]
    assert sorted(map(tuple, store.postings.read().select(*names).collect())) == sorted(map(tuple, flat.select(*names).collect()))
    store.postings.compact()
    assert store.postings.read().count() == flat.count()


def test_pairs_lie_in_the_bucket_of_their_first_word(spark, make_corpus, tmp_path):
    rows = make_corpus([(f"n{i}", "", f"memory leak w{i} w{i + 1} end", "community") for i in range(80)])
    store = CorpusStore(spark, str(tmp_path))
    store.records.replace(rows)
    store.rebuild_postings()
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} end") for i in range(5)] + [(9, "leak w7")], "query_id long, query string")
    for mode in ("phrase", "any", "all"):
        hits = kw.search_postings(store.postings.read(), queries, mode, push_grams=True).collect()
        assert sorted(map(tuple, hits)) == sorted(map(tuple, kw.keyword_search(rows, queries, mode).collect())) != []
    buckets = spark.range(64).withColumnRenamed("id", "bucket")
    assert [r.bucket for r in buckets.where(kw.in_buckets([63, 4, 5, 9])).collect()] == [4, 5, 9, 63]
    assert buckets.where(kw.in_buckets([])).count() == 0


def test_a_dictionary_that_missed_its_postings_catches_up(spark, make_corpus, tmp_path, monkeypatch):
    store = CorpusStore(spark, str(tmp_path))
    store.records.replace(make_corpus([("first", "", "memory", "community")]))
    store.rebuild_postings()
    late = make_corpus([("late", "", "memories", "community")])

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(store.terms, "append", die)
        with pytest.raises(RuntimeError, match="killed"):
            store.apply(late)
    assert not store.in_step("postings")
    assert store.update_postings() == {"added": 0, "removed": 0}
    assert sorted(r.term for r in store.terms.read().collect()) == ["first", "late", "memories", "memory"]
    store.apply(make_corpus([("last", "", "memory", "community")]))
    assert sorted(r.term for r in store.terms.read().collect()) == ["first", "last", "late", "memories", "memory"]


def test_scored_pairs_meet_their_records_before_their_units(spark, monkeypatch):
    gains = spark.createDataFrame([(u, f"r{i}", 1.0 + u) for u in range(4) for i in range(30)], "unit long, id string, gain double")
    plan = spark.createDataFrame([(q, u, u == 3 and q == 2, 1.0, 4) for q in range(5) for u in range(4)],
                                 "query_id long, unit long, negated boolean, weight double, needed long")
    pairs = spark.createDataFrame([(0, "r1"), (1, "r1"), (2, "r5"), (0, "r1")], "query_id long, id string")
    met, real = [], bounded_topk._summed
    monkeypatch.setattr(bounded_topk, "_summed", lambda frame: (met.append(frame), real(frame))[1])
    small = sorted(map(tuple, bounded_topk.scored(pairs, gains, plan, 150).collect()))
    assert small == [(0, "r1", 10.0, 4, 4), (1, "r1", 10.0, 4, 4)]
    joins = [line for line in met[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    # The innermost join, last in the plan, is the one with the records.
    assert len(joins) == 2 and "unit" not in joins[-1] and "id#" in joins[-1]
    monkeypatch.setattr(bounded_topk, "is_small", lambda *_: False)
    assert sorted(map(tuple, bounded_topk.scored(pairs, gains, plan, 150).collect())) == small
