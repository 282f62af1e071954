"""Session defaults, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# What Parquet writers put into one row group by default; a scan cannot split it.
ROW_GROUP_BYTES = 128 * 1024 * 1024
# Record files are small: thousands of them belong in one task, not the default few dozen.
OPEN_COST = "spark.sql.files.openCostInBytes"
SMALL_FILE_COST = 65_536
# Tasks that list files one by one, 10,000 by default however few the cores are; as many a core are enough.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS_PER_CORE = 8


def build_session(
    master: str | None = None, app: str = "corpusmill", shared_folder: str | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit.

    `shared_folder` becomes spark.checkpoint.dir, where written intermediates go.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        OPEN_COST: str(SMALL_FILE_COST),
        **conf,
    }
    if shared_folder:
        settings["spark.checkpoint.dir"] = shared_folder
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The shared folder for written intermediates: spark.checkpoint.dir of the session.

    Only a local session that names none gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lower_open_cost(spark: SparkSession) -> str:
    """Share out scans as `build_session` does; a lower cost stays. Returns the setting before."""
    before = spark.conf.get(OPEN_COST)
    # The setting may carry a unit; a bare number is bytes.
    if not (before.isdigit() and int(before) <= SMALL_FILE_COST):
        spark.conf.set(OPEN_COST, str(SMALL_FILE_COST))
    return before


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Scans that run inside share out files as `build_session` does, whatever the session says; a lower cost stays."""
    before = _lower_open_cost(spark)
    try:
        yield
    finally:
        spark.conf.set(OPEN_COST, before)


def streaming_copy(spark: SparkSession) -> SparkSession:
    """A copy of a session for a stream of small files.

    A file stream lists and scans each batch under the settings of the session its reader came from, whatever is set while the
    batch is handled. The copy shares catalog, cores and storage with the session.
    """
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    _lower_open_cost(copy)
    few = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    copy.conf.set(LISTING_TASKS, str(min(int(copy.conf.get(LISTING_TASKS)), few)))
    return copy


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame fits a broadcast, from its row count and the bytes of its text and arrays.

    Counts and sums combine to one row per map task. It reads the frame, so ask it of inputs and written tables, not
    of long computations.
    """
    n_rows, n_bytes = measured(df)
    return n_rows <= max_rows and n_bytes <= BROADCAST_BYTES


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of a frame and roughly their bytes in memory."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            width = width + 8 * F.greatest(F.size(name), F.lit(0))
        elif kind.startswith(("map", "struct")):
            width = width + F.octet_length(F.to_json(name))
    size = df.agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return size["n"], size["b"] or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast behind a size check; past the bound the join shuffles."""
    return F.broadcast(df) if is_small(df) else df


def batch_keys(batch: DataFrame, key: str, small: bool | None = None) -> DataFrame:
    """The keys of a batch for a semi-join: broadcast when the batch is small, else distinct.

    Distinct keys keep a hot key from meeting itself in the shuffle.
    """
    keys = batch.select(key)
    if is_small(keys) if small is None else small:
        return F.broadcast(keys)
    return keys.distinct()


def spread(df: DataFrame, path: str) -> DataFrame:
    """Deal the rows of the files at `path` over all cores when they have fewer row groups than cores.

    A scan shares out row groups, and their number is bounded by the bytes of the files, which a listing tells without
    reading them. So this never shuffles a large input, and rows are the same either way.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return df.repartition(cores) if size < cores * ROW_GROUP_BYTES else df
