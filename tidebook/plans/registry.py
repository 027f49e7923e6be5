"""The named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def as_text(levels: Column) -> Column:
    """An array as text, for engines whose array rendering differs."""
    return F.array_join(F.transform(levels, lambda x: x.cast("string")), ",")


def feed_end(ticks: DataFrame, column: str = "source_us") -> int:
    """The newest time of a feed: the default as-of of the queries."""
    return int(ticks.agg(F.max(column)).first()[0] or 0)
