"""Registration of queries with their SQL, and the form results are compared in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.standins import Data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text and integers as bigint, as the SQL gives them."""

    def column(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(value, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return value.cast("bigint").alias(field.name)
        return value

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Registers ``build(data)`` under a name, with the SQL that gives the same rows."""

    def register(build: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: comparable(build(Data(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def stamp_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def day_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"
