"""Jobs that die half-way, rows that repeat, vectors that are no numbers."""

import math

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusmill.encoders import hash_encoder
from corpusmill.operators import gates
from corpusmill.operators.nearest import vector_topk
from corpusmill.plans import jobs
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.vector_index import DimensionError
from corpusmill.sources.versions import ConcurrentWriteError, VersionedTable
from corpusmill.streaming.ingest import ingest_stream

ENCODER = hash_encoder("test-model")


@pytest.fixture
def store(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "store"))
    store.init()
    return store


def record(folder, name):
    folder.mkdir(parents=True)
    (folder / "SKILL.md").write_text(f"---\nname: {name}\ndescription: d\n---\n\nBody of {name}\n", encoding="utf-8")


@pytest.mark.parametrize("dies_in", ["index", "postings"])
def test_a_stream_that_died_between_two_writes_catches_up(spark, tmp_path, store, monkeypatch, dies_in):
    record(tmp_path / "in" / "one", "one")
    jobs.build_or_update(store, ENCODER)
    store.rebuild_postings()
    target = store.index.vectors if dies_in == "index" else store.postings

    def run():
        ingest_stream(store, str(tmp_path / "in"), str(tmp_path / "progress"), encoder=ENCODER).awaitTermination()

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(target, "append", die)
        with pytest.raises(StreamingQueryException):
            run()
    assert store.read().count() == 1
    run()
    state = jobs.status(store).first()
    assert (state.n_records, state.n_vectors, state.in_step) == (1, 1, True)
    assert store.in_step("index") and store.in_step("postings")
    queries = spark.createDataFrame([(1, "body")], "query_id long, query string")
    assert [r.name for r in jobs.keyword_hits(store, queries).collect()] == ["one"]


def test_a_stream_refuses_unvetted_repositories_and_other_encoders_before_it_writes(tmp_path, store):
    record(tmp_path / "in" / "obra" / "superpowers" / "skills" / "fine", "fine")
    record(tmp_path / "in" / "somebody" / "scraped" / "skills" / "x", "x")
    with pytest.raises(StreamingQueryException, match="somebody/scraped"):
        ingest_stream(store, str(tmp_path / "in"), str(tmp_path / "p"), importer="curated").awaitTermination()
    jobs.build_or_update(store, hash_encoder("other"))
    with pytest.raises(StreamingQueryException, match="force a rebuild"):
        ingest_stream(store, str(tmp_path / "in"), str(tmp_path / "q"), encoder=ENCODER).awaitTermination()
    assert store.read().count() == 0


def test_a_snapshot_with_equal_rows_and_one_id_under_two_bodies(spark, store, make_corpus):
    rows = make_corpus([("a", "d", "body a", "community"), ("b", "d", "body b", "community")])
    clash = rows.where("name = 'a'").withColumn("content_hash", F.lit("ffff")).withColumn("instructions", F.lit("other"))
    snapshot = rows.unionByName(rows).unionByName(rows.where("name = 'b'")).unionByName(clash)
    jobs.sync_snapshot(store, snapshot, replace=True)
    ids = [r.id for r in store.read().collect()]
    assert len(ids) == len(set(ids)) == 2
    own = make_corpus([("own", "d", "own", "community")])
    jobs.sync_snapshot(store, own, replace=True)
    result = jobs.sync_snapshot(store, snapshot)
    assert result.counts == {"total": 6, "added": 2, "replaced": 0, "skipped_duplicate": 4}
    assert store.read().count() == 3


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("limit", [1 << 25, 1])
def test_vectors_that_are_no_numbers_hide_nothing(spark, monkeypatch, k, limit):
    monkeypatch.setattr("corpusmill.operators.nearest.BROADCAST_BYTES", limit)
    rows = [(i, [1.0, i / 20]) for i in range(20)] + [(30, [math.nan, 9.0]), (31, [None, 9.0]), (32, None)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [math.nan, 1.0])], "query_id long, embedding array<double>")
    hits = vector_topk(vectors, queries, k).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in hits] == [(1, 19 - i) for i in range(k)]


def test_vectors_of_unequal_length_stop_the_search(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="vector lengths"):
        vector_topk(vectors, queries, 1).collect()


def test_the_first_vectors_set_the_dimension_of_an_index(spark, store):
    jobs.build_or_update(store, ENCODER)
    assert store.index.meta()["dimension"] is None
    schema = "id string, embedding array<float>, text_hash string"
    store.index.append(spark.createDataFrame([("a", [1.0, 2.0], "")], schema))
    assert store.index.meta() == {"dimension": 2, "embedding": ENCODER.info}
    with pytest.raises(DimensionError):
        store.index.append(spark.createDataFrame([("b", [1.0], "")], schema))
    assert store.index.read().count() == 1


def test_a_taken_version_is_not_written_over(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    table = VersionedTable(spark, str(tmp_path / "t"), rows.schema)
    table.replace(rows)
    with pytest.raises(ConcurrentWriteError):
        table._write(rows, f"{tmp_path}/t/base=0/rows/v=0")
    table.append(rows, rows)
    assert table._removals_fit(f"{tmp_path}/t/base=0", [1]) and not table._removals_fit(f"{tmp_path}/t/base=0", [0, 1])
    table.retire()
    assert not table.exists()
    table.replace(rows)
    assert table.read().count() == 1


def test_all_offenders_are_written(spark, make_corpus):
    corpus = make_corpus([(f"n{i}", "d", f"b{i}", "community") for i in range(30)])
    corpus = corpus.withColumn("source", F.concat(F.lit("x"), "name"))
    with pytest.raises(gates.UnknownSourceError, match="30 in all") as caught:
        gates.require_known_sources(corpus)
    assert spark.read.parquet(str(caught.value).split("all of them in ")[1]).count() == 30
