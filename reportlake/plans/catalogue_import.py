"""The whole catalogue file into the three tables: names first, then procedures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from reportlake.operators import csv_import
from reportlake.operators.catalog import DESCRIPTION, MODALITY
from reportlake.session import staging
from reportlake.sources.sinks import replace_table


def run_import(
    spark: SparkSession,
    database: str,
    lines: DataFrame,
    chosen: Sequence[str] | None = None,
    at: Column | None = None,
) -> dict[str, dict[str, int]]:
    """Imports the lines and returns what became of the names and of the procedures.

    ``chosen`` limits the procedures to some modalities. Every table is read again after
    the one before it was written, so the procedures find the new names' ids.
    """
    summary = {}
    with staging(spark) as area:
        staged = area.write(lines, "lines")
        for name, dim in (("modalities", MODALITY), ("descriptions", DESCRIPTION)):
            table = f"{database}.{name}"
            present = spark.read.table(table)
            summary[name] = csv_import.import_names_counts(present, staged, dim).first().asDict()
            replace_table(spark, csv_import.import_names(present, staged, dim, at), table)

        modalities, descriptions, procedures = (
            spark.read.table(f"{database}.{n}") for n in ("modalities", "descriptions", "procedures")
        )
        wanted = csv_import.of_modalities(staged, chosen)
        status = csv_import.classify_lines(wanted, procedures, modalities)
        summary["procedures"] = csv_import.import_procedures_counts(status).first().asDict()
        grown = csv_import.import_procedures(procedures, modalities, descriptions, wanted, None, at)
        replace_table(spark, grown, f"{database}.procedures")
    return summary
