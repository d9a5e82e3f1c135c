"""Mutations of tables in buckets: only the buckets that requests fall in are read and written again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.scratch import delete, new_path, scope, written
from cardloom.operators import mutations

BUCKET = "bucket"


@dataclass(frozen=True)
class Buckets:
    """A Parquet table with a folder for each bucket; a row's bucket is a hash of its keys, so hot owners are spread.

    The number of buckets is part of the folder's name: opening a table with another number fails. Rows whose keys are null
    have a bucket too. One job may write at a time.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    n: int = 1024

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/of-{self.n}"

    def number(self, names: Sequence[str]) -> Column:
        """The bucket of rows whose keys have these names, whatever their types are."""
        kinds = {f.name: f.dataType for f in self.schema}
        return F.pmod(F.xxhash64(*(F.col(f"`{x}`").cast(kinds[k]) for k, x in zip(self.keys, names, strict=True))), F.lit(self.n)).cast("int")

    def write(self, rows: DataFrame, touched: bool = False) -> None:
        """Puts rows (with their bucket) in place of the whole table, or of their own buckets alone."""
        mode = "dynamic" if touched else "static"
        spread = rows.hint("rebalance", F.col(BUCKET))
        spread.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self.folder)

    def marked(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.folder)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.marked(spark).select(*(f"`{c}`" for c in self.schema.names))


def bucketed(df: DataFrame, path: str, keys: Sequence[str], n: int = 1024) -> Buckets:
    """Writes a table in buckets. A column named bucket is refused, since that is the folders' name."""
    if any(c.lower() == BUCKET for c in df.columns):
        raise ValueError(f"a table in buckets can't have a column {BUCKET}")
    made = Buckets(path, T.StructType(list(df.schema)), tuple(keys), n)
    made.write(df.withColumn(BUCKET, made.number(keys)))
    return made


def change_touched(table: Buckets, requests: DataFrame, names: Sequence[str], change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Applies change(rows) to the rows of the buckets that requests fall in; returns these buckets' numbers.

    names: the requests' columns that hold the table's keys. change must keep a row's keys and return the table's columns.
    The driver gets bucket numbers only, at most as many as there are buckets; they prune the scan by folder. New rows are
    written apart and whole before any old one goes, so a lost executor costs a task. If the driver is stopped while buckets
    are put in place, some are old and some new: run the change again. No request: nothing is read or written.
    """
    spark = requests.sparkSession
    touched = sorted(r[0] for r in requests.select(table.number(names).alias(BUCKET)).distinct().collect())
    if not touched:
        return []
    with scope(spark):
        rows = table.marked(spark).filter(F.col(BUCKET).isin(touched)).select(*(f"`{c}`" for c in table.schema.names))
        new = written(change(rows).select(*(F.col(f"`{c}`").cast(table.schema[c].dataType).alias(c) for c in table.schema.names), table.number(table.keys).alias(BUCKET)), new_path(spark, "touched"))
        filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
        if not filled <= set(touched):
            raise ValueError("a change moved rows to buckets that no request falls in")
        if filled:
            table.write(new, touched=True)
        for empty in set(touched) - filled:
            delete(spark, f"{table.folder}/{BUCKET}={empty}")
    return touched


def patch_cards(table: Buckets, patches: DataFrame, as_of: str, order: Sequence[str] = ()) -> list[int]:
    """mutations.patch_cards() on the buckets of the patched cards, of a table in buckets of id."""
    return change_touched(table, patches, ["id"], lambda rows: mutations.patch_cards(rows, patches, as_of, order))


def delete_cards(table: Buckets, requests: DataFrame) -> list[int]:
    """mutations.delete_cards() on the buckets of the requested cards, of a table in buckets of id."""
    return change_touched(table, requests, ["id"], lambda rows: mutations.delete_cards(rows, requests))


def set_premium(table: Buckets, changes: DataFrame, order: Sequence[str] = ()) -> list[int]:
    """mutations.set_premium() on the buckets of the changed users, of a table in buckets of user_id."""
    return change_touched(table, changes, ["user_id"], lambda rows: mutations.set_premium(rows, changes, order))


def revoke_sessions(table: Buckets, tokens: DataFrame) -> list[int]:
    """mutations.revoke_sessions() on the buckets of the revoked tokens, of a table in buckets of session_token."""
    return change_touched(table, tokens, ["token"], lambda rows: mutations.revoke_sessions(rows, tokens))
