"""The dashboard's queries over the report table and the catalogue.

Distinct counts are exact. Spark groups by (key, value) before it counts, so a key with
a large part of the rows is spread over all tasks. Ties are broken by the group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.scalars import display_time, share, short_label, weekday_name
from reportlake.operators.filters import (
    Catalogue,
    Filters,
    filtered_reports,
    reports_by_description,
    reports_by_procedure,
)

TOP = 10

NO_FILTER = Filters()


def _distinct(column: str, name: str) -> Column:
    return F.count_distinct(F.col(column)).alias(name)


def _reports() -> Column:
    return _distinct("accession_number", "reports")


def _patients() -> Column:
    return _distinct("patient_id", "patients")


def _procedures() -> Column:
    return _distinct("procedure_code", "procedures")


def kpi_row(reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER) -> DataFrame:
    """Totals, distinct counts and the time range, with the mean per day."""
    dated = filtered_reports(reports, catalogue, filters).withColumn(
        "day", F.to_date("performed_at")
    )
    totals = dated.agg(
        _reports(),
        _patients(),
        _procedures(),
        _distinct("day", "days"),
        F.min("performed_at").alias("first_at"),
        F.max("performed_at").alias("last_at"),
    )
    return totals.select(
        "reports",
        F.col("reports").alias("unique_reports"),
        "patients",
        "procedures",
        "days",
        "first_at",
        "last_at",
        (F.col("reports") / F.greatest(F.col("days"), F.lit(1))).alias("mean_per_day"),
    )


def daily_counts(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER
) -> DataFrame:
    """Reports and patients per day that has any."""
    return (
        filtered_reports(reports, catalogue, filters)
        .groupBy(F.to_date("performed_at").alias("day"))
        .agg(_reports(), _patients())
    )


def fill_days(daily: DataFrame) -> DataFrame:
    """Days without reports between the first and the last, with zero counts.

    Each day emits itself and the empty days up to the next one. The window runs over
    one row per calendar day.
    """
    following = F.lead("day").over(Window.orderBy("day"))
    until = F.coalesce(F.date_sub(following, 1), F.col("day"))
    spread = daily.filter(F.col("day").isNotNull()).withColumn("__until", until)
    return spread.select(
        F.explode(F.sequence("day", "__until")).alias("date"), "day", "reports", "patients"
    ).select(
        F.col("date").alias("day"),
        *[
            F.when(F.col("date") == F.col("day"), F.col(c)).otherwise(F.lit(0)).alias(c)
            for c in ("reports", "patients")
        ],
    )


def daily_volume(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER
) -> DataFrame:
    return fill_days(daily_counts(reports, catalogue, filters)).orderBy("day")


def by_source(reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER) -> DataFrame:
    return (
        filtered_reports(reports, catalogue, filters)
        .groupBy("source")
        .agg(_reports(), _patients(), _procedures())
        .orderBy(F.desc("reports"), "source")
    )


def top_modalities(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER, k: int = TOP
) -> DataFrame:
    return (
        reports_by_procedure(reports, catalogue, filters)
        .groupBy("modality_name")
        .agg(_reports(), _patients())
        .orderBy(F.desc("reports"), "modality_name")
        .limit(k)
    )


def top_procedures(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER, k: int = TOP
) -> DataFrame:
    return (
        reports_by_procedure(reports, catalogue, filters)
        .groupBy("procedure_code", "procedure_name")
        .agg(_reports(), _patients())
        .orderBy(F.desc("reports"), "procedure_code")
        .limit(k)
        .withColumn("label", short_label("procedure_name"))
    )


def by_weekday(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER
) -> DataFrame:
    """Reports per weekday, 1 = Sunday, beside the mean over the weekdays."""
    counts = (
        filtered_reports(reports, catalogue, filters)
        .groupBy(F.dayofweek("performed_at").alias("weekday"))
        .agg(_reports())
    )
    return counts.select(
        "weekday",
        weekday_name(F.col("weekday")).alias("weekday_name"),
        "reports",
        F.avg("reports").over(Window.partitionBy()).alias("mean"),
    ).orderBy("weekday")


def by_hour(reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER) -> DataFrame:
    """Reports per hour; an hour without any is left out."""
    return (
        filtered_reports(reports, catalogue, filters)
        .groupBy(F.hour("performed_at").alias("hour"))
        .agg(_reports())
        .orderBy("hour")
    )


def top_descriptions(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER, k: int = TOP
) -> DataFrame:
    return (
        reports_by_description(reports, catalogue, filters)
        .groupBy("description")
        .agg(_reports(), _patients())
        .orderBy(F.desc("reports"), "description")
        .limit(k)
        .withColumn("label", short_label("description"))
    )


def modality_detail(
    reports: DataFrame, catalogue: Catalogue, filters: Filters = NO_FILTER
) -> DataFrame:
    """Counts per modality and its share of all; the window runs over the modalities."""
    counts = (
        reports_by_procedure(reports, catalogue, filters)
        .groupBy("modality_name")
        .agg(_reports(), _patients(), _procedures())
    )
    total = F.sum("reports").over(Window.partitionBy())
    return counts.withColumn("share", share(F.col("reports"), total)).orderBy(
        F.desc("reports"), "modality_name"
    )


def last_runs(job_metrics: DataFrame, k: int = TOP) -> DataFrame:
    return (
        job_metrics.orderBy(F.desc("run_at"), "run_mode")
        .limit(k)
        .select(
            "processed_date",
            "run_mode",
            "reports_loaded",
            "procedures_active",
            display_time("run_at").alias("run_time"),
        )
    )


def load_statistics(job_metrics: DataFrame) -> DataFrame:
    """Runs and loaded reports per run mode; the mean is rounded half to even."""
    return (
        job_metrics.groupBy("run_mode")
        .agg(
            F.count("*").alias("runs"),
            F.sum("reports_loaded").alias("total_reports"),
            F.bround(F.avg("reports_loaded"), 0).alias("mean_reports"),
            F.max("reports_loaded").alias("max_reports"),
        )
        .orderBy(F.desc("runs"), "run_mode")
    )
