"""Queries about loads, quality and volume of the report table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.operators.extract import in_window
from reportlake.operators.filters import Catalogue, within_last_days
from reportlake.schemas import REPORT_KEY


def extraction_statistics(rows: DataFrame) -> DataFrame:
    """Row count, distinct keys, procedures and patients, and the time range."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_distinct(REPORT_KEY).alias("accessions"),
        F.count_distinct("procedure_code").alias("procedures"),
        F.count_distinct("patient_id").alias("patients"),
        F.min("performed_at").alias("first_at"),
        F.max("performed_at").alias("last_at"),
    )


def top_codes(rows: DataFrame, k: int = 10) -> DataFrame:
    return (
        rows.groupBy("procedure_code")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "procedure_code")
        .limit(k)
    )


def modality_count(active: DataFrame) -> DataFrame:
    """Distinct modalities among the active procedures."""
    return active.agg(F.count_distinct("modality_name").alias("modalities"))


def total_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def month_verification(
    reports: DataFrame,
    run_mode: str,
    start: date | str | Column,
    end: date | str | Column,
    column: str = "performed_at",
) -> DataFrame:
    """Rows, distinct keys and time range per month of what one run mode loaded.

    ``column`` is what the window applies to; ``loaded_at`` gives the load window.
    """
    return (
        _loaded(reports, run_mode, start, end, column)
        .groupBy("year_month")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct(REPORT_KEY).alias("accessions"),
            F.min("performed_at").alias("first_at"),
            F.max("performed_at").alias("last_at"),
        )
        .orderBy("year_month")
    )


def _loaded(reports: DataFrame, run_mode: str, start, end, column: str) -> DataFrame:
    return reports.filter((F.col("run_mode") == run_mode) & in_window(column, start, end))


def duplicate_keys(reports: DataFrame) -> DataFrame:
    """Accession numbers that occur more than once."""
    return reports.groupBy(REPORT_KEY).agg(F.count("*").alias("rows")).filter("rows > 1")


def dry_run_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct(REPORT_KEY).alias("accessions"),
        F.count_distinct("procedure_code").alias("procedures"),
        F.count_distinct("patient_id").alias("patients"),
    )


def backfill_summary(batches: DataFrame) -> DataFrame:
    """Batches by outcome, rows, minutes and mean seconds over the successful ones.

    A batch that an earlier run had done is successful and takes no time.
    """
    done = F.col("status").isin("loaded", "counted", "empty")
    failed = F.col("status") == "failed"
    return batches.agg(
        F.count_if(~failed).alias("batches_ok"),
        F.count_if(failed).alias("batches_failed"),
        F.coalesce(F.sum("performed"), F.lit(0)).alias("performed"),
        F.coalesce(F.sum("reports_found"), F.lit(0)).alias("reports_found"),
        F.coalesce(F.sum("reports_loaded"), F.lit(0)).alias("reports_loaded"),
        (F.sum("seconds") / 60).alias("minutes"),
        F.coalesce(F.avg(F.when(done, F.col("seconds"))), F.lit(0.0)).alias("mean_seconds"),
    )


def timestamp_completeness(reports: DataFrame, column: str = "performed_at") -> DataFrame:
    return reports.agg(
        F.count("*").alias("rows"),
        F.count(column).alias("with_timestamp"),
        F.min(column).alias("first_at"),
        F.max(column).alias("last_at"),
    )


def volume_by_load(reports: DataFrame) -> DataFrame:
    """Per load day and run mode, latest day first."""
    return (
        reports.groupBy(F.to_date("loaded_at").alias("load_day"), "run_mode")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct(REPORT_KEY).alias("accessions"),
            F.count_distinct("patient_id").alias("patients"),
            F.count_distinct("procedure_code").alias("procedures"),
        )
        .orderBy(F.desc("load_day"), "run_mode")
    )


def volume_by_month(reports: DataFrame) -> DataFrame:
    """Per year and month of the procedure, latest first."""
    return (
        reports.groupBy(F.year("performed_at").alias("year"), F.month("performed_at").alias("month"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("year"), F.desc("month"))
    )


def volume_by_source(reports: DataFrame) -> DataFrame:
    return (
        reports.groupBy("source")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("patient_id").alias("patients"),
            F.min("performed_at").alias("first_at"),
            F.max("performed_at").alias("last_at"),
        )
        .orderBy("source")
    )


def modality_load_volume(
    reports: DataFrame, catalogue: Catalogue, days: int, as_of: date | str | Column | None = None
) -> DataFrame:
    """Per modality over the last load days, whether active or not."""
    modality = catalogue.procedures.select("procedure_code", "modality_id").join(
        catalogue.modalities.select("modality_id", "modality_name"), "modality_id"
    )
    return (
        within_last_days(reports, "loaded_at", days, as_of)
        .join(modality.select("procedure_code", "modality_name"), "procedure_code")
        .groupBy("modality_name")
        .agg(F.count("*").alias("rows"), F.count_distinct(REPORT_KEY).alias("accessions"))
        .orderBy(F.desc("rows"), "modality_name")
    )


def recent_runs(job_metrics: DataFrame, k: int = 1) -> DataFrame:
    return job_metrics.orderBy(F.desc("run_at"), "run_mode").limit(k)


def sample_reports(reports: DataFrame, k: int = 10) -> DataFrame:
    """The first rows by key, so that the same rows come back every time."""
    return (
        reports.orderBy(REPORT_KEY)
        .limit(k)
        .select(
            REPORT_KEY,
            "encounter_id",
            "occurrence_no",
            "order_no",
            "procedure_code",
            "performed_at",
            "year_month",
        )
    )


def loaded_on(reports: DataFrame, day: date | str | Column, k: int = 10) -> DataFrame:
    return sample_reports(reports.filter(F.to_date("loaded_at") == day), k)

