import duckdb
import pytest

import corpusmill.session as session
from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, rows
from corpusmill.plans.catalogue import QUERIES
from corpusmill.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "content_identity", "frontmatter_split", "category_from_path", "tag_normalise", "provenance_fields",
    "field_defaults", "dedup_winner", "merge_outcomes", "merge_store", "category_counts", "fetch_by_id",
    "arrival_order", "postings_build", "kw_all", "kw_not", "kw_prefix", "kw_literal", "vector_topk_batch",
    "retrieve_live", "index_status", "import_rejects", "build_or_update", "snapshot_merge",
    "composite_records", "composite_fetch", "usage_daily", "usage_streamed", "usage_rerank", "retrieval_measures", "retrieval_eval",
    "snapshot_changes", "quality_filter",
]


# Bootstrap draws come from hashes that SQL does not have; tests/test_evaluation.py compares them with a plain loop.
WITHOUT_SQL = {"retrieval_intervals"}


def test_every_catalogue_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[:3] == ["query_id", "rank", "id"] and frame.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    found = queries()[name](spark, SF_DIR)
    link = duckdb.connect()
    for table in TABLES:
        link.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = link.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(columns, cursor.fetchall())


def test_size_checks(spark):
    frame = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "array(1, 2) AS a", "map('k', 'v') AS m")
    assert session.is_small(frame)
    assert not session.is_small(frame, max_rows=99)


def test_spread_deals_small_files_over_all_cores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows.parquet")
    spark.range(100).coalesce(1).write.parquet(path)
    frame = spark.read.parquet(path)
    dealt = session.spread(frame, path)
    assert dealt is not frame
    assert sorted(r["id"] for r in dealt.collect()) == list(range(100))
    monkeypatch.setattr(session, "ROW_GROUP_BYTES", 1)
    assert session.spread(frame, path) is frame


def test_wide_rows_are_not_small(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    frame = spark.range(10).selectExpr("repeat('x', 1000) AS t")
    assert not session.is_small(frame)
    assert session.broadcast_if_small(frame) is frame


class Conf:
    """A session stand-in: only the settings the workspace reads."""

    def __init__(self, master, folder=None, context_folder=None):
        self.settings, self.master, self.folder = {"spark.checkpoint.dir": folder}, master, context_folder
        self.conf, self.sparkContext = self, self

    def get(self, key, default):
        return self.settings.get(key) or default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = f"{folder}/sub"


def test_workspace_is_the_session_setting():
    assert session.workspace(Conf("yarn", "s3a://shared/x/")) == "s3a://shared/x"
    assert session.workspace(Conf("yarn", None, "hdfs:/cp")) == "hdfs:/cp"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.workspace(Conf("yarn"))
    local = Conf("local[2]")
    assert session.workspace(local) == session.workspace(local) == local.folder


def test_materialize_writes_to_the_workspace(spark):
    frame = session.materialize(spark.range(3), "x")
    assert frame.count() == 3
    assert session.workspace(spark).split(":")[-1] in frame.inputFiles()[0]
