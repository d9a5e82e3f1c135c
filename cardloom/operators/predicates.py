"""Filters of the collections."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.rows import first_of
from cardloom.functions.text import instant

# Words in a generator's error that mean its credit is used up.
CREDIT_WORDS = ("budget", "quota", "insufficient", "exceeded", "402", "payment", "credit", "balance")


def owned_by(df: DataFrame, user_id: str) -> DataFrame:
    return df.filter(F.col("user_id") == user_id)


def of_type(df: DataFrame, card_type: str | None = None) -> DataFrame:
    """None, empty and `all` do not filter."""
    return df if not card_type or card_type == "all" else df.filter(F.col("type") == card_type)


def search_name(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Case-insensitive regular expression over the name; a pattern that can't be compiled raises ValueError here, not
    in a task: the engine that will run it has compiled it before."""
    pattern = (pattern or "").strip()
    if not pattern:
        return df
    try:
        df.sparkSession.sql("SELECT '' RLIKE :pattern", args={"pattern": "(?iu)" + pattern}).collect()
    except PySparkException as error:
        raise ValueError(f"not a regular expression: {pattern}") from error
    return df.filter(F.col("name").rlike("(?iu)" + pattern))


def lookup_row(df: DataFrame, **keys: str) -> DataFrame:
    for name, value in keys.items():
        df = df.filter(F.col(name) == value)
    return df.limit(1)


def live_files(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_deleted"))


def search_users(df: DataFrame, text: str) -> DataFrame:
    """Plain text within `name email`, not a pattern."""
    return df.filter(F.lower(F.concat("name", F.lit(" "), "email")).contains(text.lower()))


def valid_sessions(df: DataFrame, as_of: str) -> DataFrame:
    """A session that ends exactly now still holds."""
    return df.filter(instant(F.col("expires_at")) >= F.lit(as_of).cast("timestamp"))


def unpaid(status: Column) -> Column:
    return ~status.eqNullSafe("paid")


def not_paid(df: DataFrame) -> DataFrame:
    return df.filter(unpaid(F.col("payment_status")))


def active_price(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first active price of each lookup key (smallest id)."""
    df = df.filter("active")
    if keys is not None:
        df = df.filter(F.col("lookup_key").isin(keys))
    return first_of(df, ["lookup_key"], ["id"])


def classify_failures(df: DataFrame, message: str) -> DataFrame:
    spent = F.lower(F.col(message)).rlike("|".join(CREDIT_WORDS))
    return df.withColumn("status", F.when(spent, 402).otherwise(502))
