"""The dashboard's filters as a composition of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.scalars import day
from reportlake.operators.slots import slot_rows
from reportlake.schemas import MONTH_SLACK, REPORT_PARTITION


@dataclass(frozen=True)
class Catalogue:
    modalities: DataFrame
    descriptions: DataFrame
    procedures: DataFrame


@dataclass(frozen=True)
class Filters:
    """What the user picked.

    ``sources`` None means no filter and an empty list means no rows. ``modalities``
    filters only when some but not all of ``modality_options`` are picked.
    ``month_slack`` lets the period prune month partitions: it is the number of months
    ``performed_at`` may lie after ``year_month``. None takes what the report table says of
    itself (see ``sinks.read_reports``); other rows are pruned by file statistics only.
    """

    last_days: int | None = None
    as_of: date | str | Column | None = None
    sources: Sequence[str] | None = None
    modalities: Sequence[str] = ()
    modality_options: Sequence[str] | None = None
    descriptions: Sequence[str] = ()
    month_slack: int | None = None

    @property
    def picked_modalities(self) -> Sequence[str]:
        options = self.modality_options
        if options is not None and len(self.modalities) >= len(options):
            return ()
        return self.modalities

    @property
    def needs_dimensions(self) -> bool:
        return bool(self.picked_modalities or self.descriptions)


def since_day(filters: Filters) -> Column | None:
    if filters.last_days is None:
        return None
    today = F.current_date() if filters.as_of is None else day(filters.as_of)
    return F.date_sub(today, filters.last_days)


def within_last_days(
    rows: DataFrame, column: str, days: int, as_of: date | str | Column | None = None
) -> DataFrame:
    return rows.filter(F.col(column) >= since_day(Filters(last_days=days, as_of=as_of)))


def month_slack(reports: DataFrame, filters: Filters) -> int | None:
    if filters.month_slack is not None or REPORT_PARTITION not in reports.columns:
        return filters.month_slack
    return reports.schema[REPORT_PARTITION].metadata.get(MONTH_SLACK)


def report_filter(reports: DataFrame, filters: Filters) -> DataFrame:
    """Period and source; both reach the scan."""
    out = reports
    first = since_day(filters)
    if first is not None:
        out = out.filter(F.col("performed_at") >= first)
        slack = month_slack(reports, filters)
        if slack is not None:
            earliest = F.add_months(first, -slack)
            out = out.filter(F.col("year_month") >= F.date_format(earliest, "yyyy-MM"))
    if filters.sources is not None:
        picked = F.col("source").isin(list(filters.sources)) if filters.sources else F.lit(False)
        out = out.filter(picked)
    return out


def active_star(catalogue: Catalogue, filters: Filters = Filters()) -> DataFrame:
    """Active procedures of active modalities, narrowed by the dimension filters.

    One row per procedure: a description filter is a semi join, so a procedure with two
    picked descriptions does not repeat its reports.
    """
    modalities = catalogue.modalities.filter("active").select("modality_id", "modality_name")
    picked = filters.picked_modalities
    if picked:
        modalities = modalities.filter(F.col("modality_name").isin(list(picked)))
    procedures = catalogue.procedures.filter("active")
    if filters.descriptions:
        procedures = procedures.join(
            slot_rows(procedures).join(
                _picked_descriptions(catalogue, filters), "description_id", "left_semi"
            ),
            "procedure_code",
            "left_semi",
        )
    return procedures.join(modalities, "modality_id").select(
        "procedure_code", "procedure_name", "modality_name"
    )


def _picked_descriptions(catalogue: Catalogue, filters: Filters) -> DataFrame:
    return catalogue.descriptions.filter(F.col("description").isin(list(filters.descriptions)))


def filtered_reports(reports: DataFrame, catalogue: Catalogue, filters: Filters) -> DataFrame:
    """Reports behind the undimensioned queries.

    The dimensions are joined only when one of their filters is set; then reports of
    inactive procedures or modalities drop out as well.
    """
    base = report_filter(reports, filters)
    if not filters.needs_dimensions:
        return base
    codes = active_star(catalogue, filters).select("procedure_code")
    return base.join(codes, "procedure_code", "left_semi")


def reports_by_procedure(reports: DataFrame, catalogue: Catalogue, filters: Filters) -> DataFrame:
    """Reports with procedure and modality name, active ones only."""
    return report_filter(reports, filters).join(active_star(catalogue, filters), "procedure_code")


def reports_by_description(
    reports: DataFrame, catalogue: Catalogue, filters: Filters
) -> DataFrame:
    """One row per report and active description of its procedure."""
    star = active_star(catalogue, filters).select("procedure_code")
    descriptions = catalogue.descriptions.filter("active")
    if filters.descriptions:
        descriptions = descriptions.filter(F.col("description").isin(list(filters.descriptions)))
    described = (
        slot_rows(catalogue.procedures)
        .join(star, "procedure_code", "left_semi")
        .join(descriptions.select("description_id", "description"), "description_id")
        .select("procedure_code", "description")
        .distinct()
    )
    return report_filter(reports, filters).join(described, "procedure_code")
