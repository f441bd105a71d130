"""Registration of queries and composition of their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, IntegerType, ShortType

from .views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Put the views a statement uses, and those they use, in front of it."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop()):
            if name in SQL_VIEWS and name not in needed:
                needed.add(name)
                todo.append(SQL_VIEWS[name])
    ctes = ",\n".join(f"{n} AS (\n{SQL_VIEWS[n]})" for n in SQL_VIEWS if n in needed)
    if not ctes:
        return body
    head, body = "WITH RECURSIVE ", body.strip()
    if body[:5].lower() == "with ":
        return f"{head}{ctes},\n{re.sub(r'(?is)^with (recursive )?', '', body)}"
    return f"{head}{ctes}\n{body}"


def widen(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, so that both engines name the same types."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ByteType, ShortType, IntegerType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, FloatType):
            c = c.cast("double").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``, with its check SQL over the same tables."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widen(fn(Views(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap
