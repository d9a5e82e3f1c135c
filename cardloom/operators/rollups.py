"""Aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.rows import free_name
from cardloom.operators.attributes import parsed, text_of
from cardloom.operators.layout import FORMATS


def mutation_counts(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """How many rows each requested key meets, however often it is asked for; none is a 404. Rows are counted before they are joined."""
    hits = free_name(target.select(*on), "hits")
    there = target.groupBy(*on).agg(F.count(F.lit(1)).alias(hits))
    counted = keys.select(*on).distinct().join(there, on, "left").select(*on, F.coalesce(hits, F.lit(0).cast("bigint")).alias("matched"))
    return counted.withColumn("status", F.when(F.col("matched") == 0, 404).otherwise(200))


def print_job_totals(chosen: DataFrame, fmt: str = "standard", backs: bool = True) -> DataFrame:
    per_page = FORMATS[fmt][2] * FORMATS[fmt][3]
    out = chosen.groupBy("user_id").agg(F.count(F.lit(1)).alias("cards"))
    return out.withColumns({"pages": F.ceil(F.col("cards") / per_page), "steps": F.col("cards") * (2 if backs else 1)})


def field_coverage(cards: DataFrame, required: list[str], min_present: int) -> DataFrame:
    """Adds present and covered: how many of the required attributes are there and not empty."""
    values = F.array(*(text_of(F.try_element_at(parsed(F.col("attributes")), F.lit(k))) for k in required))
    present = F.size(F.filter(values, lambda v: v.isNotNull() & (v != "") & (v != "null")))
    return cards.withColumn("present", present).withColumn("covered", F.col("present") >= min_present)


#: What a build event does to the state; start and invalidated mean compiling.
STATES = {"start": "compiling", "invalidated": "compiling", "ok": "success", "warnings": "success", "failed": "failed"}


def build_rollup(events: DataFrame, as_of: str) -> DataFrame:
    """Per source of (source, event_id, ts, kind): runs, state, last success and duration, errors and warnings of the
    last run, and milliseconds of uptime per run (not a mean of durations)."""
    seq = F.struct("ts", "event_id")
    ended = F.col("kind").isin("ok", "warnings", "failed")
    out = events.groupBy("source").agg(
        F.count(F.when(ended, 1)).alias("runs"),
        F.max_by("kind", seq).alias("_last"),
        F.max_by("kind", F.when(ended, seq)).alias("_last_run"),
        F.max(F.when(F.col("kind").isin("ok", "warnings"), F.col("ts"))).alias("last_success"),
        F.max(F.when(F.col("kind") == "start", F.col("ts"))).alias("_last_start"),
        F.max(F.when(ended, F.col("ts"))).alias("_last_end"),
        F.min("ts").alias("_since"),
    )
    state = F.coalesce(*(F.when(F.col("_last") == k, v) for k, v in STATES.items()))
    uptime = F.timestamp_diff("MILLISECOND", F.col("_since"), F.lit(as_of).cast("timestamp"))
    return out.select(
        "source", "runs", state.alias("state"), "last_success",
        F.when(F.col("_last_end") >= F.col("_last_start"), F.timestamp_diff("MILLISECOND", F.col("_last_start"), F.col("_last_end"))).alias("last_duration_ms"),
        F.when(F.col("_last_run") == "failed", 1).otherwise(0).alias("errors"), F.when(F.col("_last_run") == "warnings", 1).otherwise(0).alias("warnings"),
        F.when(F.col("runs") > 0, F.round(uptime / F.col("runs")).cast("bigint")).alias("uptime_ms_per_run"),
    )
