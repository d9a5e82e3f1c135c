"""Searches that read only rows that can match: posting tables of trigrams.

A posting table has a row (gram, key) for each three neighbouring ASCII characters of a row's text, case folded. It is
sorted by gram, so that a filter on a few grams reads a few row groups. A search takes the text that every match must
hold from its pattern, intersects the postings of its grams, and verifies the rows that are left with the pattern itself.
Patterns without such text are answered by the scan, so the result is always that of the plain search.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.rows import free_name
from cardloom.functions.scratch import written
from cardloom.operators.predicates import search_name, search_users

# The characters outside ASCII that a case-insensitive pattern takes for i, s or k.
_ALIKE, _PLAIN = "ıİſK", "iisk"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, _ALIKE, _PLAIN))


def _fold(text: str) -> str:
    return text.translate(str.maketrans(_ALIKE, _PLAIN)).lower()


#: Rows that one task sorts or groups: a search's memory doesn't grow with the table.
TASK_ROWS = 1_000_000


def build_postings(df: DataFrame, key: str, text: Column, path: str) -> DataFrame:
    """gram, key of all rows with a key, written at path: range-partitioned and sorted by gram. Rows that share a key may
    repeat a posting: to tell them apart here would hold all pairs of a task in memory."""
    rows = df.select(F.col(f"`{key}`").alias("key"), folded(text).alias("t")).filter("key is not null and length(t) >= 3")
    grams = F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substr("t", i, F.lit(3)))
    pairs = rows.select("key", F.explode(F.array_distinct(grams)).alias("gram")).filter(F.col("gram").rlike(r"^[\x00-\x7F]{3}$"))
    most = rows.agg(F.sum(F.length("t") - 2)).first()[0] or 0
    salted = pairs.select("gram", "key", F.xxhash64(F.monotonically_increasing_id()).alias("salt"))  # splits rows that share a key
    ranged = salted.repartitionByRange(most // TASK_ROWS + 1, "gram", "key", "salt")
    return written(ranged.select("gram", "key").sortWithinPartitions("gram"), path)


def literals(pattern: str) -> list[list[str]] | None:
    """Of each alternative the texts that every match holds, case folded; None for a pattern with groups, classes, escapes or
    counts, which is not taken apart. A character before ? or * may be missing; + ends a text behind its character."""
    if re.search(r"[\\()\[\]{}]", pattern):
        return None
    out = []
    for branch in pattern.split("|"):
        bare = re.sub(r".[?*][?+]?", "\n", branch, flags=re.DOTALL)  # what may be missing, with its quantifier
        bare = re.sub(r"\+[?+]?|[.^$]", "\n", bare)
        out.append([_fold(x) for x in bare.split("\n") if x])
    return out


def grams_of(texts: list[str]) -> set[str]:
    return {t[i : i + 3] for t in texts for i in range(len(t) - 2) if t[i : i + 3].isascii()}


def _all_of(grams: list[str]) -> Column:
    """Aggregate: whether a group's postings hold all of the grams, however often; a bit for each, 60 at a time."""
    met = F.lit(True)
    for at in range(0, len(grams), 60):
        part = grams[at : at + 60]
        bit = F.coalesce(*(F.when(F.col("gram") == g, F.lit(1 << i).cast("bigint")) for i, g in enumerate(part)))
        met = met & F.coalesce(F.bit_or(bit) == F.lit((1 << len(part)) - 1).cast("bigint"), F.lit(False))
    return met


def candidates(postings: DataFrame, branches: list[list[str]] | None) -> DataFrame | None:
    """key of the rows that hold all grams of one alternative at least; None where an alternative has no gram."""
    sets = [sorted(grams_of(texts)) for texts in branches or []]
    if not sets or not all(sets):
        return None
    found = postings.filter(F.col("gram").isin(sorted(set().union(*sets))))
    held = [_all_of(grams) for grams in sets]
    met = held[0]
    for one in held[1:]:
        met = met | one
    dealt = found.repartition(found.count() // TASK_ROWS + 1, "key")  # else the few bytes of a common gram are coalesced to few tasks
    return dealt.groupBy("key").agg(met.alias("met")).filter("met").select("key")


def _of(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    name = free_name(df, "key")
    return df.join(keys.withColumnRenamed("key", name), F.col(f"`{key}`") == F.col(name), "left_semi")


def search_name_indexed(df: DataFrame, postings: DataFrame, pattern: str | None = None, key: str = "id") -> DataFrame:
    """search_name() over rows that the postings of the name leave. Rows without key have no postings: they are scanned."""
    keys = candidates(postings, literals((pattern or "").strip()))
    if keys is None:
        return search_name(df, pattern)
    return search_name(_of(df, key, keys).unionByName(df.filter(F.col(f"`{key}`").isNull())), pattern)


def search_users_indexed(users: DataFrame, postings: DataFrame, text: str, key: str = "user_id") -> DataFrame:
    """search_users() over rows that the postings of `name email` leave."""
    keys = candidates(postings, [[_fold(text)]])
    if keys is None:
        return search_users(users, text)
    return search_users(_of(users, key, keys).unionByName(users.filter(F.col(f"`{key}`").isNull())), text)
