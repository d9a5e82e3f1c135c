"""Payment and build events: batch folds, and the same folds as streams.

Events are ordered by (ts, event_id). A fold is an aggregate with map-side combination, so one hot session or user
needs no more than its partial maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardloom.functions.rows import first_of
from cardloom.operators.rollups import STATES

CHECKOUT, DELETED, INVOICES = "checkout.session.completed", "customer.subscription.deleted", ("invoice.paid", "invoice.payment_succeeded")


def route_events(events: DataFrame) -> DataFrame:
    """Adds route (checkout, invoice or cancelled); other types go. Works on a stream as on a table."""
    kind = F.col("type")
    route = F.when(kind == CHECKOUT, "checkout").when(kind.isin(*INVOICES), "invoice").when(kind == DELETED, "cancelled")
    return events.withColumn("route", route).filter("route is not null")


def checkout_states(events: DataFrame) -> DataFrame:
    """session_id, ts, event_id, last, paid after checkout events: the last status (paid if an event has none) and
    whether any was paid. On a stream the state keeps (ts, event_id), so a late event doesn't undo a newer one."""
    seq = F.struct("ts", "event_id")
    status = F.coalesce("payment_status", F.lit("paid"))
    done = events.filter(F.col("type") == CHECKOUT).groupBy("session_id").agg(
        F.max(seq).alias("at"), F.max_by(status, seq).alias("last"), F.max((status == "paid").cast("int")).alias("paid"))
    return done.select("session_id", "at.ts", "at.event_id", "last", (F.col("paid") == 1).alias("paid"))


def apply_checkouts(transactions: DataFrame, states: DataFrame) -> DataFrame:
    """Transactions after checkout_states(): completed with the status that the fold has reached, frozen once paid."""
    now = transactions.alias("now")
    met = now.join(states.select(F.col("session_id").alias("of"), "last", "paid").alias("done"), F.col("now.session_id") == F.col("done.of"), "left")
    go = F.col("done.last").isNotNull() & ~F.col("now.payment_status").eqNullSafe("paid")
    changed = {
        "status": F.when(go, "completed").otherwise(F.col("now.status")),
        "payment_status": F.when(go, F.when(F.col("done.paid"), "paid").otherwise(F.col("done.last"))).otherwise(F.col("now.payment_status")),
    }
    return met.select(*(changed.get(c, F.col(f"now.`{c}`")).alias(c) for c in transactions.columns))


def fold_transactions(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions after checkout events: completed with the event's payment status (paid if it has none), frozen once paid."""
    return apply_checkouts(transactions, checkout_states(events))


def entitlement_effects(events: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, until, ts, event_id of the events that set a known user's entitlement. Of several rows of a subscription the
    first (user, period end) counts."""
    subs = subscriptions.select(F.col("sub_id").alias("subscription"), F.col("user_id").alias("s_user"), "current_period_end").filter("subscription is not null")
    subs = first_of(subs, ["subscription"], ["s_user", "current_period_end"])
    met = route_events(events).join(subs, "subscription", "left")
    period = F.timestamp_seconds("current_period_end")
    person = F.when(F.col("route") == "invoice", F.col("s_user")).otherwise(F.col("user_id"))
    until = (
        F.when(F.col("route") == "checkout", F.coalesce(period, F.col("ts") + F.make_dt_interval(F.lit(31))))
        .when(F.col("route") == "invoice", period).otherwise(F.col("ts"))
    )
    effects = met.select(person.alias("user_id"), until.alias("until"), "ts", "event_id").filter("user_id is not null and until is not null")
    return effects.join(users.select("user_id"), "user_id", "left_semi")


def entitlement_states(events: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, ts, event_id, premium_until after each known user's last effective event. Replays count again, paid or not."""
    effects = entitlement_effects(events, subscriptions, users)
    seq = F.struct("ts", "event_id")
    last = effects.groupBy("user_id").agg(F.max(seq).alias("at"), F.max_by("until", seq).alias("premium_until"))
    return last.select("user_id", "at.ts", "at.event_id", "premium_until")


def fold_entitlements(events: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    return entitlement_states(events, subscriptions, users).select("user_id", "premium_until")


def build_state(events: DataFrame) -> DataFrame:
    """source, state after its last event; on a stream, to be written in update or complete mode."""
    state = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in STATES.items()), F.lit("idle"))
    return events.groupBy("source").agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"))


def debounce_stream(events: DataFrame, milliseconds: int = 250, lateness: str = "1 minute") -> DataFrame:
    """user_id, event_id, ts of the last change of each burst: sessions that a gap of more than the time ends."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    bursts = events.groupBy("user_id", F.session_window("ts", f"{milliseconds} milliseconds")).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return bursts.select("user_id", "last.event_id", "last.ts")


def write_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a streaming fold (checkout_states, entitlement_states) as Parquet: each micro-batch puts the rows that it
    has changed into a folder of its own, so a batch that is run again replaces what it wrote before."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_states(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key that write_states() has written: the fold's state, by the number of its batch."""
    return first_of(spark.read.parquet(path), [key], ["batch"], last=True).drop("batch")
