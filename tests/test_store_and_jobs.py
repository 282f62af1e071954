import shutil

import pytest
from pyspark.sql import functions as F

from corpusmill.encoders import hash_encoder
from corpusmill.functions.identity import with_identity
from corpusmill.operators.gates import UnvettedRepositoryError
from corpusmill.plans import jobs
from corpusmill.schema import conform
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.records import parse_records, scan_record_files
from corpusmill.sources.snapshots import read_snapshot, write_snapshot
from corpusmill.sources.vector_index import DimensionError, EncoderMismatchError, VectorIndex, published_location
from corpusmill.sources.versions import VersionedTable
from corpusmill.streaming.ingest import ingest_stream

ENCODER = hash_encoder("test-model")


def record(folder, name=None, body="Use it.", description="Does it", extra=""):
    folder.mkdir(parents=True, exist_ok=True)
    named = f"name: {name}\n" if name else ""
    text = f"---\n{named}description: {description}\n{extra}---\n\n{body}\n"
    (folder / "SKILL.md").write_text(text, encoding="utf-8")


@pytest.fixture
def tree(tmp_path):
    for name in ("debug-memory", "write-tests", "deploy-docker"):
        record(tmp_path / "in" / "skills" / name, name, f"Body of {name}", extra='tags: ["testing"]\n')
    return tmp_path / "in"


@pytest.fixture
def store(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "store"))
    store.init()
    return store


def names(store):
    return sorted(r.name for r in store.read().select("name").collect())


def numbers(spark, *ids):
    return spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, x string")


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), numbers(spark, 1).schema)
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(numbers(spark, 1, 2))
    table.append(numbers(spark, 3), numbers(spark, 1))
    ids = lambda: sorted(r.id for r in table.read().collect())
    assert ids() == [2, 3]
    table.append(numbers(spark, 1))
    assert ids() == [1, 2, 3]
    table.append(numbers(spark, 2), numbers(spark, 2))
    assert ids() == [1, 2, 3]
    table.remove(numbers(spark, 3))
    assert ids() == [1, 2]
    table.compact()
    assert ids() == [1, 2] and table.base() == 1
    table.retire()
    assert not table.exists()


def test_a_version_that_did_not_finish_does_not_count(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), numbers(spark, 1).schema)
    table.replace(numbers(spark, 1, 2))
    rows = tmp_path / "t" / "base=0" / "rows"
    numbers(spark, 1).select("id").write.parquet(str(tmp_path / "t" / "base=0" / "removed" / "v=1"))
    shutil.copytree(rows / "v=0", rows / "v=1", ignore=shutil.ignore_patterns("_SUCCESS", "._SUCCESS.crc"))
    assert table.read().count() == 2
    table.append(numbers(spark, 9))
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 9]


def test_directory_import_twice(tree, store):
    assert jobs.import_tree(store, str(tree), "directory").counts == {
        "total": 3, "added": 3, "replaced": 0, "skipped_duplicate": 0,
    }
    again = jobs.import_tree(store, str(tree), "directory")
    assert again.counts["skipped_duplicate"] == 3 and not again.changed()
    row = store.read().where("name = 'write-tests'").first()
    assert (row.category, row.tags, row.source) == ("write-tests", [], "community")


def test_directory_layouts(spark, tmp_path, store):
    root = tmp_path / "in"
    record(root / "a" / "b" / "s1", "s1", "1")
    record(root / "a" / "s 2+x%", "s2", "2")
    record(root / "s3", None, "3")
    (root / "bad").mkdir()
    (root / "bad" / "SKILL.md").write_text("Just some text without front matter.")
    (root / "list").mkdir()
    (root / "list" / "SKILL.md").write_text("---\n- a\n- b\n---\nbody")
    record(root / "null", "nul", "4", description="")
    result = jobs.import_tree(store, str(root), "directory")
    assert names(store) == ["SKILL", "s1", "s2"]
    assert {r.category for r in store.read().collect()} == {"s1", "s 2+x%", "s3"}
    assert {(r.ord.replace("\x01", "/"), r.reason) for r in result.rejects.collect()} == {
        ("null/SKILL.md", "missing description"),
        ("bad/SKILL.md", "front matter: none"),
        ("list/SKILL.md", "front matter: no mapping"),
    }
    assert result.counts == {"total": 4, "added": 3, "replaced": 0, "skipped_duplicate": 1}


def test_empty_tree(tmp_path, store):
    (tmp_path / "in").mkdir()
    assert jobs.import_tree(store, str(tmp_path / "in"), "directory").counts["total"] == 0


def test_undecodable_front_matter(spark, tmp_path, store):
    root = tmp_path / "in"
    record(root / "ok", "ok")
    (root / "broken").mkdir()
    (root / "broken" / "SKILL.md").write_text("---\nname: [unclosed\n---\nbody")
    files = scan_record_files(spark, str(root))
    with pytest.raises(Exception, match="front matter of broken/SKILL.md"):
        parse_records(files, "directory").collect()
    result = jobs.import_tree(store, str(root), "directory", on_error="quarantine")
    assert names(store) == ["ok"]
    assert [r.reason.startswith("front matter: ") for r in result.rejects.collect()] == [True]


def test_grouped_import(spark, tmp_path):
    root = tmp_path / "in"
    record(root / "Document Skills" / "pdf", "pdf", extra="tags: a, b\n")
    record(root / "other" / "x", "x", extra="tags: [' y ']\n")
    rows = {r.name: r for r in parse_records(scan_record_files(spark, str(root)), "anthropic").collect()}
    assert (rows["pdf"].category, rows["pdf"].tags) == ("Document Skills", ["a", "b"])
    assert (rows["x"].category, rows["x"].tags, rows["x"].source) == ("x", [" y "], "anthropic")


def test_curated_import(tmp_path, store):
    root = tmp_path / "in"
    record(root / "obra" / "superpowers" / "skills" / "brainstorming", None, extra="license: ' BSD-3-Clause '\n")
    record(root / "google" / "skills" / "skills" / "cloud" / "gke-basics", "gke-basics", "Other", extra="tags: [a, ' ']\n")
    jobs.import_tree(store, str(root), "curated")
    rows = {r.name: r for r in store.read().collect()}
    assert {n: r.category for n, r in rows.items()} == {"brainstorming": "", "gke-basics": "cloud"}
    first = rows["brainstorming"]
    assert first.source_id == "obra/superpowers:skills/brainstorming/SKILL.md"
    assert first.metadata["license"] == "MIT" and first.metadata["declared_license"] == "BSD-3-Clause"
    assert first.metadata["url"].endswith("/blob/main/skills/brainstorming/SKILL.md")
    assert rows["gke-basics"].tags == ["a"] and "declared_license" not in rows["gke-basics"].metadata


def test_unvetted_repository_stops_the_whole_import(tmp_path, store):
    root = tmp_path / "in"
    record(root / "obra" / "superpowers" / "skills" / "brainstorming", "b")
    (root / "somebody" / "scraped").mkdir(parents=True)
    with pytest.raises(UnvettedRepositoryError, match="somebody/scraped"):
        jobs.import_tree(store, str(root), "curated")
    assert store.read().count() == 0


def test_priority_upgrade_in_a_store(store, make_corpus):
    jobs.merge_batch(store, make_corpus([("low", "d", "same", "langskills")], ordered=True))
    assert jobs.merge_batch(store, make_corpus([("mid", "d", "same", "anthropic")], ordered=True)).counts["replaced"] == 1
    assert jobs.merge_batch(store, make_corpus([("late", "d", "same", "anthropic")], ordered=True)).counts["skipped_duplicate"] == 1
    assert names(store) == ["mid"]


def test_snapshots(spark, tmp_path, store, make_corpus):
    published = make_corpus([(f"hf-{i}", f"HF {i}", f"Body {i}", "langskills", "testing") for i in range(5)])
    write_snapshot(published, str(tmp_path / "snap"), "json")
    snapshot = read_snapshot(spark, str(tmp_path / "snap"), "json")
    assert jobs.sync_snapshot(store, snapshot) is None  # an empty corpus is replaced
    assert store.read().count() == 5
    merged = jobs.sync_snapshot(store, make_corpus([("own", "d", "Body 0", "community"), ("new", "d", "n", "community")]))
    assert merged.counts == {"total": 2, "added": 1, "replaced": 1, "skipped_duplicate": 0}
    jobs.build_or_update(store, ENCODER)
    jobs.sync_snapshot(store, snapshot, replace=True)
    assert store.read().count() == 5 and not store.index.exists()


def test_dedup_and_delete(spark, store, make_corpus):
    rows = [("s1", "d", "shared", "langskills"), ("s2", "d", "shared", "anthropic"), ("s3", "d", "own", "community")]
    store.records.append(make_corpus(rows))
    assert jobs.dedup_store(store) == {"before": 3, "after": 2, "removed": 1}
    assert jobs.dedup_store(store)["removed"] == 0
    assert names(store) == ["s2", "s3"]
    doomed = store.read().where("name = 's3'").select("id")
    assert jobs.delete_records(store, doomed) == 1
    assert jobs.delete_records(store, doomed) == 0
    assert names(store) == ["s2"]


def test_index_lifecycle(spark, tree, store):
    jobs.import_tree(store, str(tree), "directory", encoder=ENCODER)
    assert not store.index.exists()
    assert jobs.build_or_update(store, ENCODER) == {"added": 3, "removed": 0}
    assert jobs.build_or_update(store, ENCODER) == {"added": 0, "removed": 0}
    record(tree / "more", "more", "More")
    jobs.import_tree(store, str(tree), "directory", encoder=ENCODER)
    assert jobs.status(store).first().in_step
    jobs.delete_records(store, store.read().where("name = 'more'").select("id"))
    state = jobs.status(store).first()
    assert (state.n_records, state.n_vectors, state.n_stale) == (3, 4, 1)
    assert jobs.build_or_update(store, ENCODER) == {"added": 0, "removed": 1}
    assert store.index.meta() == {"dimension": 128, "embedding": ENCODER.info}
    other = hash_encoder("other")
    assert jobs.auto_index(store, other) == "other encoder"
    with pytest.raises(EncoderMismatchError):
        jobs.build_or_update(store, other)
    assert jobs.build_or_update(store, other, force=True)["added"] == 3


def test_a_changed_description_is_encoded_again(store, make_corpus):
    store.records.append(make_corpus([("a", "old", "body", "community")]))
    jobs.build_or_update(store, ENCODER)
    changed = make_corpus([("a", "new", "body", "community")])
    store.records.append(changed, changed)
    assert jobs.build_or_update(store, ENCODER) == {"added": 1, "removed": 1}
    assert store.index.read().count() == 1


def test_index_without_encoder_information_and_mixed_lengths(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "i"))
    schema = "id string, embedding array<float>, text_hash string"
    index.save(spark.createDataFrame([("a", [1.0], "")], schema), None)
    assert index.meta() == {"dimension": 1, "embedding": {}}
    with pytest.raises(DimensionError):
        index.save(spark.createDataFrame([("a", [1.0], ""), ("b", [1.0, 2.0], "")], schema), {})


def test_adopting_a_published_index(spark, tmp_path, store, make_corpus):
    rows = make_corpus([("a", "d", "1", "community"), ("b", "d", "2", "community")])
    store.records.append(rows)
    with pytest.raises(FileNotFoundError):
        jobs.adopt_index(store, str(tmp_path / "pub"), ENCODER)
    VectorIndex(spark, published_location(str(tmp_path / "pub"), *ENCODER.info.values())).build(rows.where("name = 'a'"), ENCODER)
    report = jobs.adopt_index(store, str(tmp_path / "pub"), ENCODER).first()
    assert (report.n_records, report.n_vectors, report.n_missing) == (2, 1, 1)


def test_search_and_fallback(spark, tree, store):
    jobs.import_tree(store, str(tree), "directory")
    queries = spark.createDataFrame([(1, "debug memory")], "query_id long, query string")
    with pytest.raises(FileNotFoundError):
        jobs.search(store, queries, ENCODER)
    assert [r.name for r in jobs.search(store, queries, ENCODER, fallback="keyword").collect()] == ["debug-memory"]
    jobs.build_or_update(store, ENCODER)
    hits = jobs.search(store, queries, ENCODER, k=2).collect()
    assert len(hits) == 2 and "instructions" not in hits[0].asDict()


def test_postings_follow_the_records(spark, tree, store):
    jobs.import_tree(store, str(tree), "directory")
    queries = spark.createDataFrame([(1, "docker"), (2, "xyz123")], "query_id long, query string")
    found = lambda mode="all": {(r.query_id, r.name) for r in jobs.keyword_hits(store, queries, mode).collect()}
    assert store.update_postings() == {"added": 3, "removed": 0}
    assert found() == {(1, "deploy-docker")}
    record(tree / "late", "late", "holds xyz123")
    jobs.import_tree(store, str(tree), "directory")
    assert found("phrase") == {(1, "deploy-docker"), (2, "late")}
    assert store.update_postings() == {"added": 0, "removed": 0}
    jobs.delete_records(store, store.read().where("name = 'late'").select("id"))
    assert found() == {(1, "deploy-docker")}
    # Records written past the store's own methods are caught up with.
    late = store.read().limit(1).withColumn("id", F.lit("by-hand")).withColumn("instructions", F.lit("xyz123"))
    store.records.append(late)
    assert store.update_postings() == {"added": 1, "removed": 0}
    assert {q for q, _ in found()} == {1, 2}


def test_stream_keeps_the_index_in_step(spark, tree, store, tmp_path, make_corpus):
    store.records.append(make_corpus([("low", "d", "Body of write-tests", "skillnet")]))
    jobs.build_or_update(store, ENCODER)
    ingest_stream(store, str(tree), str(tmp_path / "p"), encoder=ENCODER, max_files=2).awaitTermination()
    state = jobs.status(store).first()
    assert (state.n_records, state.n_vectors, state.in_step) == (3, 3, True)
    assert store.index.update(store.read(), ENCODER) == {"added": 0, "removed": 0}
    queries = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert jobs.search(store, queries, k=9).count() == 3  # the index names its own encoder


def test_an_importer_of_your_own(spark, tree, store, make_corpus):
    def whole_file(files):
        rows = files.select(F.col("path").alias("ord"), F.col("path").alias("name"), F.col("text").alias("instructions"))
        rows = rows.withColumn("description", F.lit("")).withColumn("source", F.lit("community"))
        return conform(with_identity(rows)).join(rows.select("ord", "name"), "name").withColumn("error", F.lit(None).cast("string"))

    assert jobs.import_tree(store, str(tree), whole_file).counts["added"] == 3
    assert "skills/write-tests/SKILL.md" in names(store)


def test_stream_equals_batch_and_repeats_nothing(spark, tree, store, tmp_path):
    jobs.import_tree(store, str(tree), "directory")
    streamed = CorpusStore(spark, str(tmp_path / "streamed"))
    progress = str(tmp_path / "progress")
    ingest_stream(streamed, str(tree), progress, max_files=2).awaitTermination()
    assert names(streamed) == names(store)
    record(tree / "new", "new", "New")
    ingest_stream(streamed, str(tree), progress).awaitTermination()
    assert names(streamed) == sorted([*names(store), "new"])
    # The same files under a fresh checkpoint are all skipped.
    before = streamed.records._versions(0)
    ingest_stream(streamed, str(tree), str(tmp_path / "again")).awaitTermination()
    assert streamed.records._versions(0) == before


def test_carriage_returns_read_as_newlines(spark, tmp_path):
    folder = tmp_path / "in" / "a"
    folder.mkdir(parents=True)
    (folder / "SKILL.md").write_bytes(b"---\r\nname: a\r\ndescription: d\r\n---\r\none\r\ntwo\r\n")
    row = parse_records(scan_record_files(spark, str(tmp_path / "in")), "directory").first()
    assert row.instructions == "one\ntwo"
    assert row.created_at is not None and F is not None
