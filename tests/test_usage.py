"""Usage counts in batch and as a stream, and what they do to a ranking."""

import datetime as dt
import math

from corpusmill.operators import usage
from corpusmill.streaming.usage import streamed_usage, usage_stream

SCHEMA = "ts timestamp, id string"


def _at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def _write(spark, rows, root):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)


def _run(spark, root, location, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)
    usage_stream(stream, location, checkpoint, **options).awaitTermination()
    return {(str(r.day), r.id): r.n for r in streamed_usage(spark, location).collect()}


def _batch(spark, rows):
    return {(str(r.day), r.id): r.n for r in usage.daily_usage(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    root, location, checkpoint = (str(tmp_path / n) for n in ("events", "usage", "progress"))
    first = [(_at(1, 3), "a"), (_at(1, 4), "a"), (_at(1, 5), "b"), (None, "a"), (_at(2), None)]
    _write(spark, first, root)
    assert _run(spark, root, location, checkpoint) == _batch(spark, first) == {("2024-01-01", "a"): 2, ("2024-01-01", "b"): 1}
    # Started again, the state goes on: an event of an earlier day, not yet too late, adds to it.
    second = [(_at(2, 1), "a"), (_at(1, 23), "a")]
    _write(spark, second, root)
    assert _run(spark, root, location, checkpoint) == _batch(spark, first + second)
    # Nothing new changes nothing.
    assert _run(spark, root, location, checkpoint) == _batch(spark, first + second)


def test_late_events_are_dropped_once_their_day_is_closed(spark, tmp_path):
    root, location, checkpoint = (str(tmp_path / n) for n in ("events", "usage", "progress"))
    on_time = [(_at(1, 1), "a"), (_at(9), "a")]
    for rows in (on_time, [(_at(9, 1), "b")]):
        _write(spark, rows, root)
        _run(spark, root, location, checkpoint, lateness="2 days")
    _write(spark, [(_at(1, 2), "a"), (_at(8), "c")], root)
    got = _run(spark, root, location, checkpoint, lateness="2 days")
    assert got == {("2024-01-01", "a"): 1, ("2024-01-09", "a"): 1, ("2024-01-09", "b"): 1, ("2024-01-08", "c"): 1}


def test_decay_and_rerank(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 8), (dt.date(2024, 1, 8), "a", 2), (dt.date(2024, 1, 9), "b", 5)], "day date, id string, n long")
    as_of = usage.F.lit("2024-01-08").cast("date")
    decayed = usage.decayed_usage(daily, as_of, 7.0)
    assert {r.id: r.usage for r in decayed.collect()} == {"a": 6.0}
    hits = spark.createDataFrame([(1, "b", 1.0), (1, "a", 0.9), (1, "c", 1.0), (2, "a", -0.5), (2, "d", -0.5)], "query_id int, id string, score double")
    rows = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in usage.rerank(hits, decayed, 2, boost=0.1).collect()}
    lift = 1 + 0.1 * math.log(7)
    assert rows == {(1, 1): ("a", round(0.9 * lift, 9)), (1, 2): ("b", 1.0), (2, 1): ("a", round(-0.5 / lift, 9)), (2, 2): ("d", -0.5)}
