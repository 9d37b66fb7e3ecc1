"""Writers for the report, catalogue and record tables.

Parquet tables have no MERGE. A merge here touches only the months that change: those
the batch belongs to and those where the matched keys live now. The result is staged
first, in a folder a month as the table has them, and these folders then take the places of
the table's, so no row is written twice. A failed run can be repeated from the staged copy
or from the start.

Where keys live is kept beside the table, in ``<table>__keys``: pairs of key and month in
folders by a hash of the key, so a batch reads the folders it hits and no key of the
table itself. The pairs are a superset of what the table holds. A merge adds its pairs
before it swaps months: a pair too many costs the reading of a month, a pair too few
would lose a match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reportlake.operators.curve import curve_key, quantiles
from reportlake.operators.upsert import merge_all, merge_daily
from reportlake.schemas import MONTH_SLACK, REPORT_KEY, REPORT_PARTITION, REPORTS, RUN_DAILY
from reportlake.session import CODEC, Staging, staging
from reportlake.sources.tables import conform, rename_columns, table_exists

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"

KEY_BUCKETS = 64
KEYS_TAG, KEYS_BUCKETS = "reportlake.keys", "reportlake.key_buckets"
CLUSTER_BY = ("procedure_code", "performed_at")


def _by_month(df: DataFrame) -> DataFrame:
    """Rows gathered by month into file-sized tasks; a heavy month is split up."""
    return df.hint("rebalance", REPORT_PARTITION)


def create_reports(df: DataFrame, table: str) -> None:
    """First load: the table is created, or replaced, with the schema of the rows."""
    (
        _by_month(df)
        .write.mode("overwrite")
        .option("compression", CODEC)
        .partitionBy(REPORT_PARTITION)
        .format("parquet")
        .saveAsTable(table)
    )
    build_keys(df.sparkSession, table)
    _note_slack(df.sparkSession, table)


def _note_slack(spark: SparkSession, table: str, added: DataFrame | None = None) -> None:
    """Keeps with the table by how many months ``performed_at`` lies behind its month at most.

    Seconds past midnight can push a report beyond its month. ``added`` are the rows of a
    merge; without them, or if nothing is known yet, the whole table is looked at.
    """
    known = _property(spark, table, MONTH_SLACK)
    rows = spark.read.table(table) if known is None or added is None else added
    if "performed_at" not in rows.columns:
        return
    month = F.to_date(F.concat(REPORT_PARTITION, F.lit("-01")))
    behind = F.months_between(F.trunc("performed_at", "MM"), month)
    most = int(rows.agg(F.coalesce(F.max(behind), F.lit(0.0)).alias("m")).first().m)
    most = max(0, most, int(known or 0) if added is not None else 0)
    if known is None or most != int(known):
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{MONTH_SLACK}' = '{most}')")


def read_reports(spark: SparkSession, table: str) -> DataFrame:
    """The report table; its month column says what a period may prune (``filters.month_slack``)."""
    rows = spark.read.table(table)
    slack = _property(spark, table, MONTH_SLACK)
    return rows if slack is None else rows.withMetadata(REPORT_PARTITION, {MONTH_SLACK: int(slack)})


def drop_reports(spark: SparkSession, table: str) -> None:
    """The table and its keys."""
    for name in (table, keys_table(table)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def keys_table(table: str) -> str:
    return f"{table}__keys"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(REPORT_KEY), F.lit(buckets)).cast("int").alias("bucket")


def _property(spark: SparkSession, table: str, name: str) -> str | None:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}.get(name)


def build_keys(spark: SparkSession, table: str, buckets: int = KEY_BUCKETS) -> None:
    """The key table from one scan of the table's keys.

    Both tables get the same tag when it is complete. A table that was replaced has none,
    and a merge builds its keys anew.
    """
    keys, tag = keys_table(table), uuid.uuid4().hex
    spark.sql(f"DROP TABLE IF EXISTS {keys}")
    rows = spark.read.table(table).select(REPORT_KEY, REPORT_PARTITION, _bucket(buckets)).distinct()
    gathered = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", REPORT_KEY)
    gathered.write.partitionBy("bucket").format("parquet").saveAsTable(keys)
    spark.sql(f"ALTER TABLE {keys} SET TBLPROPERTIES ('{KEYS_TAG}' = '{tag}', '{KEYS_BUCKETS}' = '{buckets}')")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{KEYS_TAG}' = '{tag}')")


def forget_keys(spark: SparkSession, table: str) -> None:
    """After rows came in by another way than a merge."""
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{KEYS_TAG}', '{MONTH_SLACK}')")


def keys_hit(spark: SparkSession, table: str, source: DataFrame) -> DataFrame:
    """Pairs of key and month in the folders that the keys of ``source`` fall into."""
    keys = keys_table(table)
    tag = _property(spark, table, KEYS_TAG)
    if tag is None or not table_exists(spark, keys) or _property(spark, keys, KEYS_TAG) != tag:
        build_keys(spark, table)
    buckets = int(_property(spark, keys, KEYS_BUCKETS))
    hit = [r.bucket for r in source.select(_bucket(buckets)).distinct().collect()]
    return spark.read.table(keys).filter(F.col("bucket").isin(hit))


def append_rows(df: DataFrame, table: str) -> None:
    """Append, creating the table when it is absent."""
    df.write.mode("append").format("parquet").saveAsTable(table)


def append_by_month(df: DataFrame, table: str) -> None:
    """Append to a table with months; its keys are built anew by the next merge."""
    rows = _by_month(df).write.mode("append").partitionBy(REPORT_PARTITION).format("parquet")
    rows.saveAsTable(table)
    forget_keys(df.sparkSession, table)


def replace_table(
    spark: SparkSession, df: DataFrame, table: str, partitions: Sequence[str] = ()
) -> None:
    """Rewrite a small table from a query that may read the table itself.

    The new table is written beside the old one and takes its name when it is complete; a
    reader finds one or the other, but for the moment between two renamings. If a step
    fails, the rows are left in the table beside, which the error names.
    """
    beside, old = (f"{table}__{kind}_{uuid.uuid4().hex[:12]}" for kind in ("new", "old"))
    try:
        df.write.format("parquet").partitionBy(*partitions).saveAsTable(beside)
        if table_exists(spark, table):
            spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {beside} RENAME TO {table}")
    except Exception as problem:
        if table_exists(spark, old) and not table_exists(spark, table):
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        raise RuntimeError(f"{table} not replaced, its new rows may be in {beside}") from problem
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    spark.catalog.refreshTable(table)


def _months(df: DataFrame) -> list[str]:
    """Month values; as many as there are calendar months in the data."""
    return [row[0] for row in df.select(REPORT_PARTITION).distinct().collect()]


def _drop_months(spark: SparkSession, table: str, months: Sequence[str]) -> None:
    for month in months:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({REPORT_PARTITION} = '{month}')")


@contextmanager
def _only_written_partitions(spark: SparkSession):
    """Inserts with overwrite replace just the partitions they write to. The session
    setting is what counts here: ``insertInto`` takes no notice of a writer option."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def _stage_months(spark: SparkSession, area: Staging, rows: DataFrame, table: str, name: str) -> DataFrame:
    """Rows staged as the table has them: its columns and types, and a folder a month."""
    return area.write(conform(rows, spark.read.table(table).schema), name, REPORT_PARTITION)


def _overwrite_months(spark: SparkSession, area: Staging, name: str, table: str) -> None:
    """The swap; when it fails half way the staged rows are all there is, so they stay.

    Folders are moved where the table lies in the same store and in Parquet files, as its own
    do from here; else the staged rows are written to it.
    """
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect()}
    try:
        if detail["Provider"].lower() != "parquet" or not area.swap(name, detail["Location"]):
            with _only_written_partitions(spark):
                area.read_back(name).select(*spark.read.table(table).columns).write.mode("overwrite").insertInto(table)
        elif detail.get("Partition Provider") == "Catalog":
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    except Exception as problem:
        area.keep()
        raise RuntimeError(f"{table} not replaced, staged rows kept in {area.root}") from problem


class ChangedMeanwhile(RuntimeError):
    """Another run wrote to months that were being merged."""


def _files_of(spark: SparkSession, table: str, months: Sequence[str]) -> list[str]:
    """The files that hold the months now. A merge expects them to be there at its end:
    Parquet tables have no transactions, so one table is to have one writer at a time."""
    spark.catalog.refreshTable(table)
    return sorted(spark.read.table(table).filter(F.col(REPORT_PARTITION).isin(months)).inputFiles())


def _replace_months(
    spark: SparkSession, area: Staging, staged: DataFrame, table: str, touched: Sequence[str]
) -> None:
    emptied = sorted(set(touched) - set(_months(staged)))
    _overwrite_months(spark, area, "merged", table)
    _drop_months(spark, table, emptied)
    spark.catalog.refreshTable(table)


def upsert_reports(spark: SparkSession, batch: DataFrame, table: str, run_mode: str) -> None:
    """Apply a deduplicated batch by the rule of its run mode; creates a missing table."""
    if not table_exists(spark, table):
        return create_reports(conform(batch, REPORTS), table)
    with staging(spark) as area:
        area.write(conform(batch, REPORTS), "batch")
        apply_staged(spark, area, "batch", table, run_mode)


def apply_staged(spark: SparkSession, area: Staging, name: str, table: str, run_mode: str) -> None:
    """``upsert_reports`` for a batch that is staged already."""
    rule = merge_daily if run_mode == RUN_DAILY else merge_all
    merge_staged(spark, area, name, table, REPORTS, rule)


def merge_staged(
    spark: SparkSession, area: Staging, name: str, table: str, schema: StructType, rule: Callable[..., DataFrame]
) -> None:
    """Merges a staged batch of unique keys into a table partitioned by month.

    Rows whose keys are new are added as they are; only the others meet the rows that are
    there, by the keys' own join first, so texts of new months are not shuffled for a match.
    """
    source = area.read(name, schema)
    if not table_exists(spark, table):
        return create_reports(source, table)

    known = keys_hit(spark, table, source)
    matched = known.join(source.select(REPORT_KEY), REPORT_KEY, "left_semi")
    touched = sorted(set(_months(source)) | set(_months(matched)))
    before = _files_of(spark, table, touched)
    affected = conform(spark.read.table(table), schema).filter(F.col(REPORT_PARTITION).isin(touched))
    hit = area.write(source.select(REPORT_KEY).join(affected.select(REPORT_KEY), REPORT_KEY, "left_semi"), "hit")
    hits, share = source.join(hit, REPORT_KEY, "left_semi"), hit.count() / max(1, source.count())
    small = area.small_enough(name, share)
    merged = rule(affected, area.write(hits, "hits") if small else hits, small_source=small)
    merged = merged.unionByName(source.join(hit, REPORT_KEY, "left_anti"))
    staged = _stage_months(spark, area, _by_month(merged), table, "merged")
    if _files_of(spark, table, touched) != before:
        raise ChangedMeanwhile(f"{table}: months {', '.join(touched)} changed during the merge")
    _add_keys(spark, area, table, source, known)
    _note_slack(spark, table, source)
    _replace_months(spark, area, staged, table, touched)


def _add_keys(spark: SparkSession, area: Staging, table: str, source: DataFrame, known: DataFrame) -> None:
    keys = keys_table(table)
    pairs = source.select(REPORT_KEY, REPORT_PARTITION).join(known, [REPORT_KEY, REPORT_PARTITION], "left_anti")
    new = area.write(pairs.withColumn("bucket", _bucket(int(_property(spark, keys, KEYS_BUCKETS)))), "new_keys")
    if not new.isEmpty():
        gathered = new.hint("rebalance", "bucket").sortWithinPartitions("bucket", REPORT_KEY)
        gathered.write.mode("append").partitionBy("bucket").format("parquet").saveAsTable(keys)
        spark.catalog.refreshTable(keys)


def compact_reports(
    spark: SparkSession,
    table: str,
    months: Sequence[str] | None = None,
    cluster_by: Sequence[str] = CLUSTER_BY,
    files: int | None = None,
) -> None:
    """Rewrites months into few files, each with a narrow range of every column of ``cluster_by``.

    Rows are cut by range of month and place on the curve over these columns; ``files`` sets
    how many pieces, else their size does. Over whole tables the keys are rebuilt.
    """
    rows = spark.read.table(table)
    if months is not None:
        rows = rows.filter(F.col(REPORT_PARTITION).isin(list(months)))
    with staging(spark) as area:
        place = curve_key(rows, cluster_by, quantiles(rows, cluster_by))
        order = [REPORT_PARTITION, "__place", *cluster_by]
        ranged = rows.withColumn("__place", place)
        ranged = ranged.repartitionByRange(files, *order) if files else ranged.repartitionByRange(*order)
        _stage_months(spark, area, ranged.sortWithinPartitions(*order).drop("__place"), table, "rows")
        _overwrite_months(spark, area, "rows", table)
    spark.catalog.refreshTable(table)
    if months is None:
        build_keys(spark, table)


def rename_table_columns(spark: SparkSession, table: str, renames: dict[str, str]) -> None:
    """Column rename on a Parquet table: the rows are rewritten under the new names."""
    partitions = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    renamed = rename_columns(spark.read.table(table), renames)
    replace_table(spark, renamed, table, [renames.get(p, p) for p in partitions])
