"""Streams give what the batch folds give."""

import os

import pytest
from pyspark.sql import functions as F

from cardloom.sources.adapters import collection
from cardloom.streaming import streams

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")


@pytest.fixture
def arrived(spark, tmp_path):
    """A collection as files that arrive one per trigger."""
    def write(name, parts=3):
        table = collection(spark, DATA, name)
        path = str(tmp_path / name)
        for i in range(parts):
            ordered = table.orderBy("ts").withColumn("_p", F.floor(F.percent_rank().over(__import__("pyspark").sql.Window.orderBy("ts")) * (parts - 0.001)))
            ordered.filter(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(path)
        return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path), str(tmp_path / f"{name}-check")

    return write


def run(stream, name, mode, check):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_routes(spark, arrived):
    table, stream, check = arrived("payments")
    run(streams.route_events(stream).select("event_id", "route"), "routes", "append", check)
    assert sorted(spark.table("routes").collect()) == sorted(streams.route_events(table).select("event_id", "route").collect())


def test_build_state(spark, arrived):
    table, stream, check = arrived("builds")
    run(streams.build_state(stream), "builds_now", "complete", check)
    assert sorted(spark.table("builds_now").collect()) == sorted(streams.build_state(table).collect())


@pytest.mark.parametrize("late", [False, True])
def test_transactions_and_entitlements(spark, tmp_path, late):
    """States written by streams equal the batch folds, whether events come in order or the newest come first."""
    table = collection(spark, DATA, "payments")
    users, subs, start = (collection(spark, DATA, n) for n in ("users", "subscriptions", "transactions"))
    edges = table.agg(F.percentile_approx("event_id", [0.34, 0.67])).first()[0]
    parts = [table.filter(F.col("event_id") <= edges[0]), table.filter(F.col("event_id").between(edges[0] + 1, edges[1])), table.filter(F.col("event_id") > edges[1])]
    where = str(tmp_path / "payments")
    os.mkdir(where)
    stream = spark.readStream.schema(table.schema).parquet(where)
    folds = {"session_id": streams.checkout_states(stream), "user_id": streams.entitlement_states(stream, subs, users)}
    for part in reversed(parts) if late else parts:
        part.coalesce(1).write.mode("append").parquet(where)
        for key, fold in folds.items():  # each run takes what has come since the last one
            streams.write_states(fold, f"{tmp_path}/{key}", f"{tmp_path}/{key}-check").awaitTermination(120)
    key = lambda df: sorted((r["session_id"], r["status"], r["payment_status"]) for r in df.collect())
    states = streams.read_states(spark, f"{tmp_path}/session_id", "session_id")
    assert key(streams.apply_checkouts(start, states)) == key(streams.fold_transactions(table, start))
    until = streams.read_states(spark, f"{tmp_path}/user_id", "user_id").select("user_id", "premium_until")
    assert sorted(until.collect()) == sorted(streams.fold_entitlements(table, subs, users).collect())


def test_debounce(spark, arrived):
    table, stream, check = arrived("keystrokes")
    six = 6 * 3600 * 1000
    run(streams.debounce_stream(stream, six), "typed", "append", check)
    batch = {tuple(r) for r in streams.debounce_stream(table, six).collect()}
    got = {tuple(r) for r in spark.table("typed").collect()}
    newest = max(r[2] for r in batch)
    assert got <= batch and all((newest - r[2]).total_seconds() <= 6 * 3600 + 120 for r in batch - got)  # open bursts are still held
