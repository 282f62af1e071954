"""Thousands of small files: how they are written, listed and read."""

from pyspark.sql import functions as F

from corpusmill.plans import tables as tb
from corpusmill.session import LISTING_TASKS, OPEN_COST, streaming_copy
from corpusmill.sources.corpus_store import CorpusStore
from corpusmill.sources.folders import write_text_files
from corpusmill.sources.records import scan_record_files
from corpusmill.streaming.ingest import ingest_stream


def tree(root):
    return sorted((str(p.parent.relative_to(root)), p.read_bytes()) for p in root.rglob("part-*"))


def test_files_are_those_of_sparks_writer_without_checksums(spark, tmp_path):
    kinds = ["plain", "a b", "x=y/z", "%", "é", "", None, "plain", "[q]?'\"\t"]
    texts = ["one", "zwei\nlines\n", "", None, "é 𐐷", "six", "seven", "one", "\r\nnine"]
    rows = spark.createDataFrame([("org", k, t) for k, t in zip(kinds, texts)], "owner string, repo string, value string").repartition(3)
    write_text_files(rows, str(tmp_path / "own"), "owner", "repo")
    rows.write.option("maxRecordsPerFile", 1).partitionBy("owner", "repo").text(str(tmp_path / "sparks"))
    assert tree(tmp_path / "own") == tree(tmp_path / "sparks") and len(tree(tmp_path / "own")) == 9
    assert not [p for p in (tmp_path / "own").rglob("*") if p.is_file() and not p.name.startswith("part-")]
    write_text_files(rows.limit(0), str(tmp_path / "none"), "owner", "repo")
    assert scan_record_files(spark, str(tmp_path / "none")).count() == 0


def test_the_record_tree_is_written_by_its_tasks(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"src{i % 3}", 6) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    tb.write_record_tree(spark, str(tmp_path), str(tmp_path / "tree"))
    assert not list((tmp_path / "tree").rglob("*.crc")) and len(tree(tmp_path / "tree")) == 30
    assert {folder for folder, _ in tree(tmp_path / "tree")} == {f"owner=org/repo=src{n}" for n in range(3)}


def test_whole_files_are_read_as_bytes(spark, tmp_path):
    for name, body in (("a", b"one\r\ntwo\n"), ("b", b""), ("c", "é \U00010437".encode()), ("d", b"bad \xff byte")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_bytes(body)
    # Spark leaves empty files out of either scan.
    found = scan_record_files(spark, str(tmp_path))
    # The reader of whole texts copies the settings for every file.
    assert "binaryFile" in found._jdf.queryExecution().executedPlan().toString()
    as_text = spark.read.text(str(tmp_path), wholetext=True, recursiveFileLookup=True)
    hexed = lambda frame, c: sorted(r[0] for r in frame.select(F.hex(F.col(c).cast("binary"))).collect())
    assert hexed(found, "text") == hexed(as_text, "value") and found.count() == 3


def test_a_stream_lists_and_scans_in_few_tasks(spark, tmp_path):
    n = 12 * spark.sparkContext.defaultParallelism + 40
    for i in range(n):
        (tmp_path / "in" / f"r{i}").mkdir(parents=True)
        (tmp_path / "in" / f"r{i}" / "SKILL.md").write_text(f"---\nname: n{i}\ndescription: d\n---\nbody {i}")
    before = {key: spark.conf.get(key) for key in (OPEN_COST, LISTING_TASKS)}
    store = CorpusStore(spark, str(tmp_path / "store"))
    query = ingest_stream(store, str(tmp_path / "in"), str(tmp_path / "progress"))
    query.awaitTermination()
    assert store.read().count() == n and {key: spark.conf.get(key) for key in before} == before
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(job).stageIds]
    sizes = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert sizes and max(sizes) < n


def test_a_copy_keeps_lower_settings_and_the_session_its_own(spark):
    copy = streaming_copy(spark)
    copy.conf.set(LISTING_TASKS, "3")
    copy.conf.set(OPEN_COST, "1000")
    again = streaming_copy(copy)
    assert (again.conf.get(LISTING_TASKS), again.conf.get(OPEN_COST)) == ("3", "1000")
    assert spark.conf.get(LISTING_TASKS) != "3"
