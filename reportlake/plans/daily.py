"""The daily run: one window from the source systems into the report table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from reportlake.operators.extract import (
    active_codes,
    attach_patients,
    attach_texts,
    choose_reports,
    fetch_texts,
    one_per_accession,
    performed_in_window,
    processing_window,
    stamp,
    to_report_rows,
)
from reportlake.schemas import JOB_METRICS, RUN_DAILY
from reportlake.session import Staging, staging
from reportlake.sources.sinks import append_rows, compact_reports, apply_staged
from reportlake.sources.systems import SourceTables, check_run_mode

LOADED = "loaded"
NO_PROCEDURES = "no active procedure"
NOTHING_PERFORMED = "no procedure performed in the window"
NO_REPORTS = "no report found in the window"


def _stage_window(
    area: Staging, tables: SourceTables, codes: DataFrame, window: tuple[date, date]
) -> tuple[DataFrame, SourceTables]:
    """The performed procedures of a window, staged, and the sources narrowed to their keys.

    Those with their patients are staged as "with_patient".

    The narrow rows are staged before they meet the report texts. Their size is then
    known when that join is planned: a day or a week of them is sent to the texts, and
    the texts, which have no date to filter on, are scanned but not shuffled.
    """
    performed = area.write(performed_in_window(tables.performed, codes, *window), "performed")
    if not performed.isEmpty():
        tables = tables.narrowed(performed)
        area.write(attach_patients(performed, tables.encounters), "with_patient")
    return performed, tables


def window_rows(
    area: Staging, tables: SourceTables, codes: DataFrame, window: tuple[date, date]
) -> tuple[DataFrame, DataFrame]:
    """The performed procedures of a window, and all report rows they lead to."""
    performed, tables = _stage_window(area, tables, codes, window)
    if performed.isEmpty():
        return performed, performed.limit(0)
    with_patient = area.read_back("with_patient")
    return performed, to_report_rows(attach_texts(with_patient, tables.reports, hash_below=False))


def window_batch(
    area: Staging, tables: SourceTables, codes: DataFrame, window: tuple[date, date]
) -> tuple[DataFrame, DataFrame]:
    """The performed procedures of a window, and one report row per accession number."""
    performed, tables = _stage_window(area, tables, codes, window)
    if performed.isEmpty():
        return performed, performed.limit(0)
    return performed, deduplicated(area, "with_patient", tables.reports)


def deduplicated(area: Staging, name: str, reports: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One report row per accession number for staged rows; a text is shuffled once at most.

    Few rows are sent to the texts, and only what matched is shuffled, for the choice. More
    rows choose first, on keys and hashes of texts, and the chosen ones fetch their texts in
    a second scan.
    """
    with_patient = area.read_back(name)
    if area.small_enough(name):
        return one_per_accession(to_report_rows(attach_texts(with_patient, reports, hash_below=False), also=also), also)
    chosen = area.write(choose_reports(with_patient, reports, also), f"{name}_chosen")
    return fetch_texts(chosen, reports, also)


@dataclass(frozen=True)
class RunOutcome:
    """What a run did; ``metrics`` is None when it ended early."""

    status: str
    window: tuple[date, date]
    metrics: dict | None = None


def run_daily(
    spark: SparkSession,
    tables: SourceTables,
    procedures: DataFrame,
    run_modes: DataFrame,
    reports_table: str,
    metrics_table: str | None = None,
    mode: str = RUN_DAILY,
    day_to_process: date | str | None = None,
    back_days: int = 1,
    compact: bool = False,
) -> RunOutcome:
    """Extract, deduplicate, stamp and upsert one window, then record its metrics.

    The batch is staged once; counts and the merge read the staged copy.
    """
    check_run_mode(run_modes, mode)
    window = processing_window(mode, day_to_process, back_days)
    codes = active_codes(procedures)
    active = codes.count()
    if not active:
        return RunOutcome(NO_PROCEDURES, window)
    with staging(spark) as area:
        performed, rows = window_batch(area, tables, codes, window)
        performed_rows = performed.count()
        if not performed_rows:
            return RunOutcome(NOTHING_PERFORMED, window)
        batch = area.write(stamp(rows, mode), "extracted")
        loaded = batch.count()
        if not loaded:
            return RunOutcome(NO_REPORTS, window)
        months = [r[0] for r in batch.select("year_month").distinct().collect()]
        apply_staged(spark, area, "extracted", reports_table, mode)

    if compact:
        compact_reports(spark, reports_table, months)
    metrics = {
        "processed_date": window[1] - timedelta(days=1),
        "period_start": window[0],
        "period_end": window[1],
        "run_mode": mode,
        "procedures_active": active,
        "procedures_performed": performed_rows,
        "reports_loaded": loaded,
        "total_reports": spark.read.table(reports_table).count(),
        "run_at": datetime.now(),
    }
    if metrics_table:
        record = tuple(metrics[name] for name in JOB_METRICS.fieldNames())
        append_rows(spark.createDataFrame([record], JOB_METRICS), metrics_table)
    return RunOutcome(LOADED, window, metrics)
