"""Catalog tables: scans, existence, inspection, creation, columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import schemas

CATALOGUE_TABLES = {
    "modalities": schemas.MODALITIES,
    "descriptions": schemas.DESCRIPTIONS,
    "procedures": schemas.PROCEDURES,
}


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


def run_query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """A parameterised statement; the result stays lazy and failures are raised."""
    return spark.sql(sql, args=parameters) if parameters else spark.sql(sql)


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def catalogue_exists(spark: SparkSession, database: str) -> bool:
    return all(table_exists(spark, f"{database}.{t}") for t in CATALOGUE_TABLES)


def create_catalogue(spark: SparkSession, database: str) -> None:
    """The three catalogue tables, where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in CATALOGUE_TABLES.items():
        table = f"{database}.{name}"
        if not table_exists(spark, table):
            spark.createDataFrame([], schema).write.saveAsTable(table)


def drop_catalogue(spark: SparkSession, database: str) -> None:
    """Procedures first, as they refer to the other two."""
    for name in reversed(CATALOGUE_TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def list_columns(spark: SparkSession, table: str) -> list[tuple[str, str, bool]]:
    return [(c.name, c.dataType, c.isPartition) for c in spark.catalog.listColumns(table)]


def list_partitions(df: DataFrame, column: str = schemas.REPORT_PARTITION) -> DataFrame:
    """The partitions that hold rows."""
    return df.select(column).distinct().orderBy(column)


def lower_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Schema migration as a projection; missing old names are an error."""
    missing = set(renames) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumnsRenamed(dict(renames))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a table in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
