"""Streams whose state ends: expiry, late events, restarts and compaction."""

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from cardloom.streaming import latest

FLAT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()),
                     T.StructField("value", T.StringType()), T.StructField("flag", T.BooleanType())])


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


class Feed:
    """Files that arrive one after another, each taken by a query that is started again."""

    def __init__(self, spark, folder, compact_every=8):
        self.spark, self.folder, self.compact_every = spark, str(folder), compact_every
        os.mkdir(f"{folder}/in")

    def send(self, *rows):
        self.spark.createDataFrame([(k, at(m), e, v, v == "paid") for k, m, e, v in rows], FLAT).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(FLAT).parquet(f"{self.folder}/in")
        rows = latest.newest_events(stream, "session_id", "10 minutes", "60 minutes")
        latest.write_newest(rows, f"{self.folder}/out", f"{self.folder}/check", "session_id", self.compact_every).awaitTermination(120)

    def table(self):
        found = latest.read_newest(self.spark, f"{self.folder}/out", "session_id", T.LongType())
        return {r["session_id"]: (r["event_id"], r["value"], r["flag"]) for r in found.collect()}

    def late(self):
        return sorted((r["session_id"], r["event_id"]) for r in latest.read_late(self.spark, f"{self.folder}/out", "session_id", T.LongType()).collect())

    def kinds(self, kind):
        rows = latest._read(self.spark, f"{self.folder}/out", latest.table_schema("session_id", T.LongType())).filter(f"kind = '{kind}'")
        return sorted((r["session_id"], r["event_id"]) for r in rows.collect())


def test_states_end_and_late_events_are_kept_apart(spark, tmp_path):
    feed = Feed(spark, tmp_path, compact_every=100)
    assert feed.table() == {} and feed.late() == []
    feed.send(("a", 0, 1, "unpaid"), ("b", 1, 2, "paid"), (None, 1, 3, "paid"), ("a", 0, 0, "older"))
    assert feed.table() == {"a": (1, "unpaid", False), "b": (2, "paid", True)}
    feed.send(("b", 5, 4, "unpaid"), ("c", 30, 5, "x"))  # once paid stays flagged; the watermark moves to minute 20
    assert feed.table()["b"] == (4, "unpaid", True)
    feed.send(("a", 3, 6, "too late"), ("c", 29, 7, "older, in time"))
    assert feed.late() == [("a", 6)] and feed.table()["a"] == (1, "unpaid", False) and feed.table()["c"] == (5, "x", False)
    assert feed.kinds("closed") == []
    feed.send(("d", 200, 8, "y"))  # minute 190: all others have been quiet for an hour
    feed.send(("a", 201, 9, "paid"))  # a key that has ended begins anew; its table row is one still
    assert feed.kinds("closed") == [("a", 1), ("b", 4), ("c", 5)]
    assert feed.table() == {"a": (9, "paid", True), "b": (4, "unpaid", True), "c": (5, "x", False), "d": (8, "y", False)}


def test_folders_are_merged(spark, tmp_path):
    feed = Feed(spark, tmp_path, compact_every=2)
    for i in range(5):
        feed.send(("k", 20 * i, i, f"v{i}"), (f"only{i}", 20 * i, i, "x"))
        folders = [f for f in os.listdir(f"{tmp_path}/out") if "=" in f]
        assert len(folders) <= 3
    assert any(f.startswith("base=") for f in folders)
    assert feed.table() == {"k": (4, "v4", False)} | {f"only{i}": (i, "x", False) for i in range(5)}


def test_lengths_of_time():
    assert latest._seconds("2 days") == 172_800 and latest._seconds("1 minute") == 60
    with pytest.raises(ValueError):
        latest._seconds("soon")


class Handle:
    """Stands for state and timers of one key, and counts the calls that go to the engine."""

    def __init__(self):
        self.value, self.timers, self.calls, self.watermark = None, [], 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_change_takes_two_calls_and_no_frame():
    handle = Handle()
    fold = latest.Newest("session_id", T.LongType(), 60)
    fold.init(handle)
    event = lambda second, n: T.Row(session_id="a", at=second * 1_000_000, event_id=n, value="v", flag=False)
    for n in range(5):
        assert [(r["kind"], r["event_id"]) for r in fold.handleInputRows(("a",), iter([event(10 * n, n)]), handle)] == [("state", n)]
    assert handle.timers == [60_000] and handle.calls == 5 * 2 + 1
    handle.watermark = 61_000  # the timer of the first event fires; the key was active until second 40
    assert list(fold.handleExpiredTimer(("a",), handle, None)) == [] and handle.timers == [60_000, 100_000]
    handle.watermark = 101_000
    assert [(r["kind"], r["event_id"]) for r in fold.handleExpiredTimer(("a",), handle, None)] == [("closed", 4)] and handle.value is None
