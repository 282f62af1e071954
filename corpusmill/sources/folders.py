"""Listing and naming of folders on whatever file system a path belongs to."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How Spark names the folder of a null or empty value, and the characters that it writes as %XX in such names.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^" + "".join(map(chr, range(1, 32))))


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def exists(spark: SparkSession, location: str) -> bool:
    files, path = _path(spark, location)
    return files.exists(path)


def child_folders(spark: SparkSession, location: str) -> list[str]:
    """Names of the folders directly below a location, sorted; none when it does not exist."""
    files, path = _path(spark, location)
    if not files.exists(path):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())


def make_folder(spark: SparkSession, location: str) -> None:
    files, path = _path(spark, location)
    files.mkdirs(path)


def delete_file(spark: SparkSession, location: str) -> None:
    files, path = _path(spark, location)
    files.delete(path, False)


def _without_scheme(location: str) -> str:
    return location.split(":", 1)[1].lstrip("/") if ":" in location.split("/", 1)[0] else location.lstrip("/")


def qualified(spark: SparkSession, location: str) -> str:
    """The absolute location without scheme and leading slashes, as `file_location` writes it."""
    _, path = _path(spark, location)
    return _without_scheme(path.toString()).rstrip("/")


def file_location() -> Column:
    """Location of the file a row comes from, decoded, without scheme and leading slashes."""
    raw = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(raw, r"\A[A-Za-z][A-Za-z0-9+.-]*:/*", "")


def _part(column: str, value: str | None) -> str:
    named = "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value) if value else NO_VALUE
    return f"{column}={named}"


def write_text_files(rows: DataFrame, root: str, *folders: str) -> None:
    """Every `value` as a text file of its own, below folders named after string columns.

    Hadoop's local file system starts a process, `chmod`, for each file that it makes and for its checksum, which takes ten
    times as long as the file. So the tasks write local files on their own; any other file system is left to Spark's writer.
    A task that runs again writes the same names.
    """
    spark = rows.sparkSession
    files, path = _path(spark, root)
    if files.getUri().getScheme() != "file":
        # Each task moves its own files in place: the driver would move them one by one.
        writer = rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        return writer.partitionBy(*folders).text(root)
    files.mkdirs(path)
    top = path.toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, made = pyspark.TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for *parts, value in zip(*(batch.column(c).to_pylist() for c in (*folders, "value"))):
                folder = "/".join([top, *map(_part, folders, parts)])
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(f"{folder}/part-{task:05d}-{n:07d}.txt", "wb") as file:
                    file.write(f"{value or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.select(*folders, "value").mapInArrow(write, "n long").agg(F.sum("n")).collect()
