"""Registration of queries and their SQL twins, and the common form of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def publish(df: DataFrame) -> DataFrame:
    """Doubles to 6 places (sums depend on the order of addition), dates as ISO text."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def published_sql(body: str, doubles: str, dates: str) -> str:
    changes = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split()]
    changes += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    inner = f"SELECT * FROM (\n{body.strip()}\n) AS result"
    if not changes:
        return inner
    return inner.replace("SELECT *", f"SELECT * REPLACE ({', '.join(changes)})", 1)


def query(key: str, sql: str | None = None, doubles: str = "", dates: str = ""):
    """Register a query. ``sql`` may be left out where SQL cannot express the result."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: publish(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = published_sql(sql, doubles, dates)
        return fn

    return register
