import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import keyword as kw
from corpusmill.operators.terms import prefix_terms
from corpusmill.plans import jobs
from corpusmill.plans import tables as tb
from corpusmill.sources.corpus_store import CorpusStore

WORDS = "alpha beta gamma delta école node js memory memories leak the of a b".split()


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    planted = lambda i: " The of, a b! the of a b" if i % 9 == 0 else ""
    return [(f"r{i:03d}", say(2), say(rng.randint(0, 6)), say(rng.randint(0, 60)) + planted(i)) for i in range(120)]


@pytest.fixture(scope="module")
def corpus(spark, records):
    return spark.createDataFrame(records, "id string, name string, description string, instructions string").cache()


@pytest.fixture(scope="module")
def fts(records):
    link = sqlite3.connect(":memory:")
    try:
        link.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, name, description, instructions)")
    except sqlite3.OperationalError:
        pytest.skip("this sqlite has no FTS5")
    link.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", records)
    return link


def spark_hits(spark, corpus, query, mode, **options):
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    rows = kw.keyword_search(corpus, queries, mode, limit=1000, **options).collect()
    return {r.id: round(r.score, 6) for r in rows}


def fts_hits(link, expression):
    rows = link.execute("SELECT id, rank FROM t WHERE t MATCH ?", (expression,)).fetchall()
    return {ident: round(-rank, 6) for ident, rank in rows}


CASES = [
    ("memory leak", "all", {}, "memory leak"),
    ("memory leak memory", "all", {}, "memory leak memory"),
    ("école gamma", "any", {}, "école OR gamma"),
    ("node js", "phrase", {}, '"node js"'),
    ("the of a", "phrase", {}, '"the of a"'),
    ("the of a b", "phrase", {}, '"the of a b"'),
    ("memor", "prefix", {}, "memor*"),
    ("memor del", "prefix", {}, "memor* del*"),
    ("alpha", "all", {"columns": ["name"]}, "name : alpha"),
    ("alpha beta", "any", {"columns": ["name", "description"]}, "{name description} : (alpha OR beta)"),
]


@pytest.mark.parametrize(("query", "mode", "options", "expression"), CASES)
def test_scores_match_fts5(spark, corpus, fts, query, mode, options, expression):
    expected = fts_hits(fts, expression)
    assert expected
    assert spark_hits(spark, corpus, query, mode, **options) == expected


def test_exclusion_matches_fts5(spark, corpus, fts):
    expected = fts_hits(fts, "alpha NOT (leak OR beta)")
    assert expected
    assert spark_hits(spark, corpus, "alpha", "all", exclude=F.lit("leak beta")) == expected


def test_odd_queries_never_raise(spark, corpus):
    odd = ['"unclosed quote', "c++", "C#", "node.js", "test*", "(debug)", "()", "NOT AND OR", "", "   "]
    queries = spark.createDataFrame(list(enumerate(odd)), "query_id long, query string")
    for mode in kw.MODES:
        hits = kw.keyword_search(corpus, queries, mode).collect()
        assert not {r.query_id for r in hits} & {6, 8, 9}


def test_limits_and_ranks(spark, corpus):
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id long, query string")
    rows = kw.keyword_search(corpus, queries, "any", limit=3).collect()
    assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, n) for q in (1, 2) for n in (1, 2, 3)]
    assert kw.keyword_search(corpus, queries, limit=0).count() == 0
    with pytest.raises(ValueError, match="negative"):
        kw.keyword_search(corpus, queries, limit=-1)
    with pytest.raises(ValueError, match="mode"):
        kw.keyword_search(corpus, queries, "near")


def test_empty_corpus(spark, corpus):
    queries = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert kw.keyword_search(corpus.limit(0), queries, "any").count() == 0


def test_large_query_sets_take_the_shuffled_join(spark, corpus, monkeypatch):
    queries = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "query_id long, query string")
    small = {tuple(r) for r in kw.keyword_search(corpus, queries, "any").collect()}
    monkeypatch.setattr(kw, "is_small", lambda *_: False)
    assert {tuple(r) for r in kw.keyword_search(corpus, queries, "any").collect()} == small


@pytest.mark.parametrize("limit", [1, 3, 10])
@pytest.mark.parametrize("exclude", [None, "leak of"])
def test_pruned_hits_are_the_best_of_all(spark, corpus, limit, exclude):
    """The bounded search against the same search without a threshold."""
    rng = random.Random(limit)
    asked = [(i, " ".join(rng.choices(WORDS, [9, 1, 1, 1, 1, 3, 1, 5, 1, 2, 9, 9, 9, 5], k=rng.randint(1, 9)))) for i in range(25)]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    options = {} if exclude is None else {"exclude": F.lit(exclude)}
    every = kw.keyword_search(corpus, queries, "any", limit=1000, **options).where(F.col("rank") <= limit)
    got = kw.keyword_search(corpus, queries, "any", limit=limit, **options)
    order = lambda frame: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in frame.collect())
    assert order(got) == order(every) != []


def test_few_pairs_are_scored(spark):
    """Of the pairs that share a word, less than a quarter is scored."""
    folder = "/root/testdata/sf0.01"
    rows, queries = tb.corpus(spark, folder), tb.passages(spark, folder)
    postings = kw.build_postings(rows, pairs=False)
    words = queries.select("query_id", F.explode(kw.tokens(F.col("query"))).alias("gram")).distinct()
    sharing = postings.where("words = 1").select("id", "gram").join(words, "gram").select("query_id", "id").distinct().count()
    scored = kw.matched(postings, queries, "any", None, None, 10, False, None).count()
    assert 10 * queries.count() <= scored < sharing / 4


def test_prefixes_are_ranges_of_the_sorted_terms(spark):
    terms = ["a", "ab", "abc", "ac", "b", "été", "é", "𐐷x", "z" * 40]
    prefixes = ["a", "ab", "abcd", "é", "e", "z", "𐐷", "abc"]
    got = prefix_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    want = sorted((p, t) for p in prefixes for t in terms if t.startswith(p))
    assert sorted(tuple(r) for r in got.collect()) == want
    none = spark.createDataFrame([], "prefix string")
    assert prefix_terms(spark.createDataFrame([("a",)], "term string"), none).collect() == []


def test_many_terms_per_prefix(spark):
    terms = spark.range(5_000).selectExpr("format_string('w%05d', id) AS term")
    prefixes = spark.createDataFrame([("w",), ("w01",), ("w04999",)], "prefix string")
    got = {r.prefix: r.n for r in prefix_terms(terms, prefixes).groupBy("prefix").agg(F.count_distinct("term").alias("n")).collect()}
    assert got == {"w": 5_000, "w01": 1_000, "w04999": 1}


def test_stored_prefixes_read_the_dictionary_and_the_buckets(spark, make_corpus, tmp_path):
    rows = make_corpus([(f"n{i}", "", f"word{i} memory leak", "community") for i in range(30)])
    store = CorpusStore(spark, str(tmp_path))
    store.records.replace(rows)
    store.rebuild_postings()
    store.apply(make_corpus([("late", "", "wordy memories", "community")]))
    queries = spark.createDataFrame([(1, "wordy"), (2, "word2"), (3, "memor")], "query_id long, query string")
    hits = jobs.keyword_hits(store, queries, "prefix", limit=100).collect()
    found = {q: sorted(r.name for r in hits if r.query_id == q) for q in (1, 2, 3)}
    assert found == {1: ["late"], 2: sorted(["n2", *(f"n{i}" for i in range(20, 30))]), 3: sorted(["late", *(f"n{i}" for i in range(30))])}
    assert {"wordy", "memories", "word7"} <= {r.term for r in store.terms.read().collect()}


@pytest.mark.parametrize("columns", [None, ["description"]])
def test_prefixes_of_too_many_terms_shuffle_no_postings(spark, make_corpus, monkeypatch, columns):
    rows = make_corpus([(f"n{i}", f"memo{i % 7} x", f"m memory{i} wort{i % 3} é{i} 𐐷𐐷{i % 2} a{'b' * (i % 6)}", "community") for i in range(60)])
    queries = spark.createDataFrame(
        [(1, "memory"), (2, "m"), (3, "me wor"), (4, "memory memory1 m"), (5, "é"), (6, "𐐷 ab"), (7, "abbb a"), (8, "zz"), (9, "")],
        "query_id long, query string",
    )
    options = {"limit": 100, "columns": columns, "exclude": F.lit("wort1 memory59")}
    rounded = lambda hits: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in hits.collect())
    want = rounded(kw.keyword_search(rows, queries, "prefix", **options))
    frames, real = [], kw._matches
    monkeypatch.setattr(kw, "_matches", lambda *args: (frames.append(real(*args)), frames[-1])[1])
    monkeypatch.setattr(kw, "is_small", lambda frame: frame.count() < 60)
    assert rounded(kw.keyword_search(rows, queries, "prefix", **options)) == want
    assert want or columns
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(gram" in line]


def test_the_last_prefix_does_not_end_a_shorter_one(spark):
    terms = spark.createDataFrame([(t,) for t in ("z", "zebra", "zoo", "zz")], "term string")
    found = prefix_terms(terms, spark.createDataFrame([("z",), ("ze",)], "prefix string")).collect()
    assert sorted(map(tuple, found)) == [("z", "z"), ("z", "zebra"), ("z", "zoo"), ("z", "zz"), ("ze", "zebra")]
