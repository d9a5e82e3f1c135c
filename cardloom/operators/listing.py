"""Sorted, capped lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.rows import free_name
from cardloom.functions.text import instant
from cardloom.operators.predicates import of_type, owned_by, search_name, search_users
from cardloom.operators.projections import conform, redact, with_entitlement_label, with_premium
from cardloom.sources import schemas


def newest(df: DataFrame, n: int = 1000, key: str = "id") -> DataFrame:
    """Newest first, ties by key: one top-k, no global sort."""
    return df.orderBy(F.desc(instant(F.col("created_at"))), key).limit(n)


def newest_of_each(df: DataFrame, by: str = "user_id", n: int = 1000, key: str = "id") -> DataFrame:
    """The newest n rows of every group. The rank limit is applied by each task before rows are moved, so no group of many
    rows is gathered: at most n of them come from a task."""
    rank = free_name(df, "rank")
    order = Window.partitionBy(by).orderBy(F.desc(instant(F.col("created_at"))), key)
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n).drop(rank)


def list_cards(df: DataFrame, user_id: str, card_type: str | None = None, search: str | None = None) -> DataFrame:
    """One user's collection, as the list shows it."""
    found = search_name(of_type(owned_by(df, user_id), card_type), search)
    return conform(newest(found), schemas.CARD, schemas.CARD_DEFAULTS)


def admin_list(users: DataFrame, as_of: str, search: str | None = None) -> DataFrame:
    found = newest(users, key="user_id")
    if search:
        found = search_users(found, search)
    return with_entitlement_label(with_premium(redact(found, ["password_hash"]), as_of))
