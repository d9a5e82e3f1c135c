"""One row of several, as aggregates with map-side combination; row numbers; names for helper columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.scratch import new_path, scope, written


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not use yet (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def _key(names: Sequence[str | Column]) -> Column:
    return F.struct(*(F.col(f"`{n}`") if isinstance(n, str) else n for n in names))


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each group of rows that agree in `by`, nulls included, in the given order."""
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*(F.col(f"`{c}`") for c in df.columns)), _key(order)).alias("row")
    return df.groupBy(*(F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(by))).agg(row).select("row.*")


def last_set(df: DataFrame, by: Sequence[str], fields: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """`by` and, of each field, the last value that is not null: what requests leave that are applied one after another.

    Requests that `order` does not tell apart are taken in the order of the values.
    """
    known = lambda f: F.when(F.col(f"`{f}`").isNotNull(), _key([*order, f]))
    return df.groupBy(*(F.col(f"`{c}`") for c in by)).agg(*(F.max_by(F.col(f"`{f}`"), known(f)).alias(f) for f in fields))


def _ranged(df: DataFrame, by: Sequence[str], sort: Sequence[str | Column], salt: str, part: str) -> tuple[DataFrame, list[Column]]:
    """The rows in range partitions on group and order, written once with their partition number, and the full order.

    A hash splits rows that agree in all. So a group is never held by one task, whatever its share of the rows.
    """
    full = [*(F.col(f"`{o}`") if isinstance(o, str) else o for o in sort), F.col(salt)]
    ranged = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*(F.col(f"`{b}`") for b in by), *full)
    return written(ranged.withColumn(part, F.spark_partition_id()), new_path(df.sparkSession, "ranged")), full


def _same(left: str, right: str, part: str, by: Sequence[str]) -> Column:
    same = F.col(f"{left}.{part}") == F.col(f"{right}.{part}")
    for b in by:
        same = same & F.col(f"{left}.`{b}`").eqNullSafe(F.col(f"{right}.`{b}`"))
    return same


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds a gapless number from 0 within each group of rows that agree in `by`, in the given order.

    Each range partition numbers its own rows of a group, and a running sum of the counts tells where it starts. The result
    is written, so that using it several times numbers once; scope() deletes it.
    """
    salt, part, n, start, row = (free_name(df, x) for x in ("salt", "part", "n", "start", "row"))
    keys, path = [F.col(f"`{b}`") for b in by], new_path(df.sparkSession, "numbered")
    with scope(df.sparkSession):
        ranged, sort = _ranged(df, by, order, salt, part)
        counts = ranged.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(n))
        before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(part, *keys, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
        own = Window.partitionBy(part, *by).orderBy(*sort)
        left, right = ranged.withColumn(row, F.row_number().over(own) - 1).alias("l"), starts.alias("r")
        out = left.join(right, _same("l", "r", part, by))
        return written(out.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col(f"r.{start}") + F.col(f"l.{row}")).alias(name)), path)


def with_next(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the value of the next row of the group, in the given order; null for the last one.

    Each range partition looks ahead among its own rows; the first row of a group in a partition is carried back to the
    group's last row in the partition before, of which there are few. The result is written, as number_rows() does.
    """
    salt, part, first, ahead, last = (free_name(df, x) for x in ("salt", "part", "first", "ahead", "last"))
    keys, path = [F.col(f"`{b}`") for b in by], new_path(df.sparkSession, "next")
    with scope(df.sparkSession):
        ranged, sort = _ranged(df, by, order, salt, part)
        firsts = ranged.groupBy(part, *keys).agg(F.min_by(F.col(f"`{value}`"), F.struct(*sort)).alias(first))
        carried = firsts.select(part, *keys, F.lead(first).over(Window.partitionBy(*by).orderBy(part)).alias(first))
        own = Window.partitionBy(part, *by).orderBy(*sort)
        left = ranged.withColumns({ahead: F.lead(F.col(f"`{value}`")).over(own), last: F.lead(F.lit(1)).over(own).isNull()}).alias("l")
        out = left.join(carried.alias("r"), _same("l", "r", part, by))
        following = F.when(F.col(f"l.{last}"), F.col(f"r.{first}")).otherwise(F.col(f"l.{ahead}"))
        return written(out.select(*(F.col(f"l.`{c}`") for c in df.columns), following.alias(name)), path)


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, combine: Callable[[Column, Column], Column], name: str, fan_in: int = 64) -> DataFrame:
    """`by` and the values of each group's rows combined in order by an associative function.

    Rows are numbered by range partitions, then fan_in neighbours at a time are combined, in as many rounds as the longest
    group needs (5 million rows: four). No list is longer than fan_in, and a group's rows are spread over all tasks.
    """
    v, n, some = (free_name(df, x) for x in ("value", "number", "some"))
    keys = [F.col(f"`{b}`") for b in by]
    path = new_path(df.sparkSession, "fold")
    with scope(df.sparkSession):
        now = number_rows(df.withColumn(v, value), by, order, n)
        most = now.agg(F.max(n)).first()[0] or 0
        while True:
            near = now.groupBy(*keys, F.expr(f"{n} div {fan_in}").alias(n)).agg(F.sort_array(F.collect_list(F.struct(n, v))).alias(some))
            now = near.select(*keys, n, F.aggregate(F.slice(some, 2, fan_in), F.get(some, F.lit(0))[v], lambda a, x: combine(a, x[v])).alias(v))
            most //= fan_in
            if not most:
                break
        return written(now.select(*keys, F.col(v).alias(name)), path)
