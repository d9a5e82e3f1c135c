"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.sources.adapters import collection, twin

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and twins of one theme."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, tables: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
        """build gets the named collections; times are read and written in UTC."""
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(*(collection(spark, sf_dir, t) for t in tables.split()))

        query.__name__ = name
        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = twin(sql)


def iso(column: Column | str) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S.%f')"
