"""Folds of endless streams whose state ends: the newest event of each key, in arbitrary stateful processing.

A key keeps (at, event_id, value, flag): the value of its newest event and whether any event was flagged. An event-time timer
closes a key that has been quiet for `retention`; its last row stays in the table. Events behind the watermark change
nothing: they come out as rows of their own (kind late), as do the changed states (state) and the ended ones (closed).

The table is a list of folders, one for each micro-batch, so a batch that is run again replaces what it wrote. Every few
batches all are merged to one base and deleted: it holds a row for each key and never more than `compact_every` folders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardloom.functions.scratch import delete
from cardloom.streaming.streams import CHECKOUT, entitlement_effects

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("at", "event_id", "value", "flag")


def _seconds(text: str) -> int:
    found = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", text)
    if not found:
        raise ValueError(f"no length of time: {text}")
    return int(found[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[found[2]]


class Newest(StatefulProcessor):
    """Keeps a key's newest event; emits (kind, key, at, event_id, value, flag)."""

    def __init__(self, key: str, id_type: T.DataType, retention: int):
        self.key, self.id_type, self.retention = key, id_type, retention * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("at", T.LongType()), T.StructField("event_id", self.id_type), T.StructField("value", T.StringType()), T.StructField("flag", T.BooleanType()), T.StructField("timer", T.LongType())]
        self.state = handle.getValueState("newest", T.StructType(fields))

    def _row(self, key, kind: str, values: tuple) -> Row:
        return Row(**{"kind": kind, self.key: key[0], **dict(zip(FIELDS, values, strict=True))})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        now = self.state.get()
        newest, flag, late, changed = (tuple(now[:3]) if now else None), bool(now and now[3]), [], False
        for given in rows:
            row = tuple(given[f] for f in FIELDS)
            if row[0] < horizon:
                late.append(row)
                continue
            changed, flag = True, flag or bool(row[3])
            if newest is None or row[:2] > newest[:2]:
                newest = row[:3]
        out = []
        if changed:
            due = now[4] if now else newest[0] // 1000 + self.retention
            if not now:  # a timer that newer events have overtaken is set anew when it fires: no calls for each change
                self.handle.registerTimer(due)
            self.state.update((*newest, flag, due))
            out.append(self._row(key, "state", (*newest, flag)))
        return iter(out + [self._row(key, "late", row) for row in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.state.get()
        if not now:
            return iter([])
        due = now[0] // 1000 + self.retention
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            self.state.update((*now[:4], due))
            return iter([])
        self.state.clear()
        return iter([self._row(key, "closed", tuple(now[:4]))])

    def close(self) -> None:
        pass


def newest_events(stream: DataFrame, key: str, delay: str, retention: str) -> DataFrame:
    """kind, key, at (microseconds), event_id, value, flag of a stream (key, ts, event_id, value, flag)."""
    timed = stream.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    # `at` is not the watermark's own column, so that late events reach the processor instead of vanishing before it
    given = timed.select(F.col(key).cast("string").alias(key), F.unix_micros("ts").alias("at"), "event_id", F.col("value").cast("string").alias("value"), "flag")
    id_type = given.schema["event_id"].dataType
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField(key, T.StringType()), T.StructField("at", T.LongType()), T.StructField("event_id", id_type), T.StructField("value", T.StringType()), T.StructField("flag", T.BooleanType())])
    return given.groupBy(key).transformWithState(Newest(key, id_type, _seconds(retention)), out, outputMode="Update", timeMode="EventTime")


def checkout_events(events: DataFrame) -> DataFrame:
    """session_id, ts, event_id, value (its payment status, paid if it has none), flag (paid) of completed checkouts."""
    status = F.coalesce("payment_status", F.lit("paid"))
    return events.filter(F.col("type") == CHECKOUT).select("session_id", "ts", "event_id", status.alias("value"), (status == "paid").alias("flag"))


def entitlement_events(events: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, ts, event_id, value (end of the entitlement in microseconds), flag of events that change one."""
    effects = entitlement_effects(events, subscriptions, users)
    return effects.select("user_id", "ts", "event_id", F.unix_micros("until").cast("string").alias("value"), F.lit(False).alias("flag"))


def _merged(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: its newest event, flagged if any was."""
    seq = F.struct("at", "event_id")
    return rows.groupBy(key).agg(F.max(seq).alias("top"), F.max_by("value", seq).alias("value"), F.max("flag").alias("flag")).select(key, "top.at", "top.event_id", "value", "flag")


def _folders(spark: SparkSession, path: str) -> tuple[int, list[tuple[str, int]]]:
    """The number of the newest complete base (-1: none) and all folders (name, number) that count or have been merged."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1, []
    ended = [x.getPath().getParent().getName() for x in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*/_SUCCESS"))]
    numbered = [(name, int(name.split("=")[1])) for name in ended]
    return max((n for name, n in numbered if name.startswith("base=")), default=-1), numbered


def _read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    base, found = _folders(spark, path)
    names = [name for name, n in found if name == f"base={base}" or (name.startswith("batch=") and n > base)]
    if not names:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    parts = [reader.parquet(f"{path}/{name}") for name in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_newest(rows: DataFrame, path: str, checkpoint: str, key: str, compact_every: int = 8) -> StreamingQuery:
    """Runs newest_events() over all that has arrived, into the table at path."""
    spark = rows.sparkSession
    wide = T.StructType([*(f for f in rows.schema if f.name != "kind"), T.StructField("kind", T.StringType())])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")
        if (number + 1) % compact_every == 0:
            session = batch.sparkSession
            now = _read(session, path, wide)
            kept = _merged(now.filter("kind <> 'late'"), key).withColumn("kind", F.lit("state")).unionByName(now.filter("kind = 'late'"))
            kept.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/base={number}")
            for name, n in _folders(session, path)[1]:
                if n < number or name == f"batch={number}":
                    delete(session, f"{path}/{name}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def table_schema(key: str, id_type: T.DataType) -> T.StructType:
    fields = ((key, T.StringType()), ("at", T.LongType()), ("event_id", id_type), ("value", T.StringType()), ("flag", T.BooleanType()), ("kind", T.StringType()))
    return T.StructType([T.StructField(n, t) for n, t in fields])


def read_newest(spark: SparkSession, path: str, key: str, id_type: T.DataType) -> DataFrame:
    """key, at, event_id, value, flag: one row for each key that the stream has seen in time."""
    schema = table_schema(key, id_type)
    rows = _read(spark, path, schema)
    return _merged((spark.createDataFrame([], schema) if rows is None else rows).filter("kind <> 'late'"), key)


def read_late(spark: SparkSession, path: str, key: str, id_type: T.DataType) -> DataFrame:
    """key, at, event_id, value, flag of the events that came behind the watermark."""
    schema = table_schema(key, id_type)
    rows = _read(spark, path, schema)
    return (spark.createDataFrame([], schema) if rows is None else rows).filter("kind = 'late'").drop("kind")


def checkout_table(newest: DataFrame) -> DataFrame:
    """session_id, last, paid, as apply_checkouts() takes them."""
    return newest.select("session_id", F.col("value").alias("last"), F.col("flag").alias("paid"))


def entitlement_table(newest: DataFrame) -> DataFrame:
    return newest.select("user_id", F.timestamp_micros(F.col("value").cast("bigint")).alias("premium_until"))
