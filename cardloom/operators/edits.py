"""Edit logs of attributes that are too long for one list a card.

`add` takes the first free campo_1, campo_2, ..., which depends on all edits before it. It is solved number by number
instead of edit by edit. Adds look at numbers in rising order. A number that no edit names is taken by the first add that
gets to it, if the card didn't have it; so between two named numbers, adds are matched with free numbers by rank. A named
number is taken by an add if what happened to it just before was a removal (or nothing, and the card didn't have it); so a
look at the row before decides. All other adds go on to the next number. Then every edit sets or removes a known key, and
each key's edits are folded as (removed, first set since, last value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.rows import free_name, number_rows, ordered_fold, with_next
from cardloom.functions.scratch import new_path, scope, written


def _number(key: Column) -> Column:
    """The number of a key that an add could choose, else null."""
    return F.when(key.rlike(r"^campo_[1-9][0-9]{0,17}\z"), F.substr(key, F.lit(7)).try_cast("bigint"))


def _free_after(start: Column, rank: Column) -> Column:
    """The free number of the given rank (from 0) above start; `present` holds the numbers of the card, sorted."""
    return F.aggregate(F.filter("present", lambda p: p > start), start + rank + 1, lambda x, p: F.when(p <= x, x + 1).otherwise(x))


def _chosen_numbers(log: DataFrame, present: DataFrame) -> DataFrame:
    """id, at, number of every add. One round for each number that a card's edits name, all cards at once."""
    spark = log.sparkSession
    adds, puts = log.filter("action = 'add'").select("id", "at"), log.filter("action <> 'add' and number is not null")
    by_number = Window.partitionBy("id").orderBy("number")
    named = puts.select("id", "number").distinct().join(adds.select("id").distinct(), "id", "left_semi")
    named = named.withColumns({"round": F.row_number().over(by_number), "prev": F.coalesce(F.lag("number").over(by_number), F.lit(0).cast("bigint"))})
    named = written(named, new_path(spark, "named"))
    chosen = []
    for i in range(1, (named.agg(F.max("round")).first()[0] or 0) + 1):
        level = named.filter(F.col("round") == i).join(present, "id")
        between = F.filter("present", lambda p: (p > F.col("prev")) & (p < F.col("number")))
        level = level.withColumns({"free": F.col("number") - F.col("prev") - 1 - F.size(between), "had": F.array_contains("present", F.col("number"))})
        by_rank = F.when(F.col("n") < F.col("free"), _free_after(F.col("prev"), F.col("n")))
        met = number_rows(adds, ["id"], ["at"], "n").join(level, "id", "left").select("id", "at", by_rank.alias("got"), "number", "had")
        met = written(met, new_path(spark, "met"))
        waiting = met.filter("got is null and number is not null").select("id", "at", F.lit("add").alias("action"), "number", "had")
        own = puts.join(level.select("id", "number", "had"), ["id", "number"]).select("id", "at", "action", "number", "had")
        seen = with_next(waiting.union(own).withColumn("back", -F.col("at")), ["id"], ["back"], "action", "before").filter("action = 'add'")
        takes = F.coalesce(F.col("before") == "remove", ~F.col("had"))
        chosen += [met.filter("got is not null").select("id", "at", F.col("got").alias("number")), seen.filter(takes).select("id", "at", "number")]
        adds = met.filter("got is null and number is null").select("id", "at").union(seen.filter(~takes).select("id", "at"))
        if adds.isEmpty():
            break
    last = named.groupBy("id").agg(F.max("number").alias("last"))
    left = number_rows(adds, ["id"], ["at"], "n").join(present, "id").join(last, "id", "left")
    out = left.select("id", "at", _free_after(F.coalesce("last", F.lit(0).cast("bigint")), F.col("n")).alias("number"))
    for c in chosen:
        out = out.union(c)
    return out


def fold_long_logs(maps: DataFrame, edits: DataFrame, order: Sequence[str]) -> DataFrame:
    """maps (id, now: map<string, string>; ids unique) after all edits (id, action, key, value) of their ids, as written table.

    Only the keys that a card has before, after or in the end are ever in one row; its edits are spread over all tasks.
    """
    spark, at, path = maps.sparkSession, free_name(edits, "at"), new_path(maps.sparkSession, "edited")
    with scope(spark):
        log = number_rows(edits, ["id"], [*order, "action", "key", "value"], at)
        log = log.select("id", F.col(at).alias("at"), "action", "key", "value", _number(F.col("key")).alias("number"))
        numbers = F.filter(F.transform(F.map_keys("now"), _number), lambda n: n.isNotNull())
        present = written(maps.select("id", F.sort_array(numbers).alias("present")), new_path(spark, "present"))
        added = _chosen_numbers(log, present).select("id", "at", F.lit("set").alias("action"), F.concat(F.lit("campo_"), F.col("number").cast("string")).alias("key"), F.lit("").alias("value"))
        steps = log.filter("action <> 'add'").select("id", "at", "action", "key", "value").union(added)
        is_set = F.col("action") == "set"
        step = F.struct((~is_set).alias("removed"), F.when(is_set, F.col("at")).alias("since"), F.when(is_set, F.col("value")).alias("value"))

        def then(a: Column, b: Column) -> Column:
            since = F.when(b["removed"], b["since"]).otherwise(F.coalesce(a["since"], b["since"]))
            return F.struct((a["removed"] | b["removed"]).alias("removed"), since.alias("since"), b["value"].alias("value"))

        ends = ordered_fold(steps, ["id", "key"], ["at"], step, then, "end")
        had = maps.select("id", F.posexplode(F.map_entries("now")).alias("pos", "e")).select("id", "e.key", "pos", F.col("e.value").alias("old"))
        both = had.join(ends, ["id", "key"], "full").filter("end is null or end.since is not null")
        stays = F.col("pos").isNotNull() & ~F.coalesce("end.removed", F.lit(False))
        place = F.when(stays, F.col("pos").cast("bigint")).otherwise(F.col("end.since"))
        entry = F.struct((~stays).alias("new"), place.alias("place"), "key", F.when(F.col("end").isNull(), F.col("old")).otherwise(F.col("end.value")).alias("value"))
        entries = both.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        done = F.map_from_entries(F.transform(F.coalesce("entries", F.array()), lambda x: F.struct(x["key"], x["value"])))
        return written(maps.select("id").join(entries, "id", "left").select("id", done.alias("attributes")), path)
