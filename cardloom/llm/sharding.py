"""Operator 5: rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number from the record key and its own name; the lowest draw, divided by the shard's weight on
a logarithmic scale, wins. A new shard only takes the records that it wins; all others stay where they are.
Built-in functions only. Slots are gapless numbers within a shard in the order of key, size and checksum, made by
counting in range partitions and adding up the counts, so that no task ever holds a shard.

Null keys are hashed as the empty text. Repeated rows get slots of their own, in any order. Null text has size 0 plus the
overhead and the checksum of no bytes; texts of any length are read whole, and none is shuffled. An empty table gives an
empty one. Other columns may have any names: shard_table() leaves them out, assign() refuses a name that is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.rows import number_rows

#: Hex digits of the digest that make a draw (13 digits are 52 bits, exact in a double).
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard alone."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _scored(key: Column, weights: Sequence[float]) -> list[Column]:
    key = F.coalesce(key.cast("string"), F.lit(""))
    return [F.struct((-F.log(draw(key, s)) / float(w)).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard, 0 to len(weights) - 1; ties (none in practice) go to the lower number."""
    return F.array_min(F.array(*_scored(key, weights)))["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """Adds the shard of each row, under a name that the table must not have yet; no shuffle."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already")
    return df.withColumn(name, shard_of(F.col(f"`{key}`"), weights))


def shard_table(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more of equal weight)."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    scores = F.array(*_scored(F.col(f"`{key}`"), [1.0] * (shards + 1)))
    rows = df.select(
        F.col(f"`{key}`").alias("k"),
        (F.octet_length(content) + overhead).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        scores.alias("scores"),  # each draw is made once: the new shard's is the last
    )
    rows = rows.select("k", "size", "text_crc32", "law", F.array_min(F.slice("scores", 1, shards))["shard"].cast("int").alias("shard"), F.array_min("scores")["shard"].cast("int").alias("grown_shard"))
    out = number_rows(rows, ["shard"], ["k", "size", "text_crc32"], "slot")
    return out.select(F.col("k").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
