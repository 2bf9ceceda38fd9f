"""Registry of named queries and their DuckDB oracle text.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is ANSI SQL over the
driver's views. Output conventions shared by both sides: doubles rounded to 4
places, timestamps as ``yyyy-MM-dd HH:mm:ss`` text, arrays joined to text,
every column aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def r4(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 4)


def ts_text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
