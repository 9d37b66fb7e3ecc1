"""The structuring job: reports in, structured reports out, one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reportlake.functions.scalars import non_blank
from reportlake.functions.text import preprocess_report
from reportlake.operators.extract import in_window
from reportlake.operators.extractors import EMPTY_TEXT, Extractor, align, rule_extractor
from reportlake.operators.prompts import prompt_column
from reportlake.operators.structure import EXAMINATION_LABELS, build_response
from reportlake.operators.upsert import merge_all
from reportlake.schemas import REPORT_KEY, REPORT_PARTITION, STRUCTURED_BY_MONTH, STRUCTURED_REPORTS
from reportlake.session import staging
from reportlake.sources.sinks import append_by_month, append_rows, merge_staged, replace_table
from reportlake.sources.tables import conform, list_columns, table_exists

RULE_MODEL = "rules"


def select_reports(
    reports: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    limit: int | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """All reports with a text in the window, or the first ``limit`` by key if one is given.

    Key, text and the columns in ``also``.
    """
    chosen = reports.filter(in_window("performed_at", start, end))
    chosen = chosen.filter(F.col("report_text").isNotNull())
    if limit:
        chosen = chosen.orderBy(REPORT_KEY).limit(limit)
    return chosen.filter(non_blank("report_text")).select(REPORT_KEY, "report_text", *also)


def structure_texts(
    reports: DataFrame,
    extractor: Extractor = rule_extractor,
    repair: bool = True,
    clean: bool = True,
    examination_labels=EXAMINATION_LABELS,
) -> DataFrame:
    """Cleaned text, extractions, error, segments, JSON documents and formatted text.

    A text that is empty after cleaning, or that the extractor fails on, is kept with
    its error. ``clean`` False takes texts that are cleaned already.
    """
    text = preprocess_report("report_text", repair) if clean else F.col("report_text")
    cleaned = reports.withColumn("clean_text", text)
    found = cleaned.withColumn("__found", extractor(F.col("clean_text")))
    empty = ~non_blank("clean_text")
    split = found.select(
        *cleaned.columns,
        F.col("__found.ok").alias("extractions"),
        F.coalesce(F.col("__found.error"), F.when(empty, EMPTY_TEXT)).alias("error"),
    )
    aligned = split if extractor is rule_extractor else align(split, "clean_text")
    return build_response(aligned, examination_labels=examination_labels)


def structured_reports(
    reports: DataFrame,
    extractor: Extractor = rule_extractor,
    model: str = RULE_MODEL,
    temperature: float = 0.0,
    loaded_at: Column | None = None,
    repair: bool = True,
    schema: StructType = STRUCTURED_REPORTS,
) -> DataFrame:
    """Rows of the structured-report table; further columns of ``schema`` come from the reports."""
    done = structure_texts(reports, extractor, repair)
    failed = F.col("error").isNotNull()
    rows = done.select(
        REPORT_KEY,
        "segments_json",
        "annotated_document_json",
        "formatted_text",
        F.when(failed, "").otherwise(prompt_column(F.col("clean_text"))).alias("raw_prompt"),
        F.lit(model).alias("model"),
        F.lit(float(temperature)).alias("temperature"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("loaded_at"),
        *[name for name in schema.fieldNames() if name not in STRUCTURED_REPORTS.fieldNames()],
    )
    return conform(rows, schema)


def run_structuring(
    spark: SparkSession,
    reports_table: str,
    output_table: str,
    start: date | str | None = None,
    end: date | str | None = None,
    limit: int | None = None,
    extractor: Extractor = rule_extractor,
    model: str = RULE_MODEL,
    temperature: float = 0.0,
    upsert: bool = False,
) -> None:
    """Structures reports and appends them, or with ``upsert`` replaces earlier results.

    The output has the months of the reports. An upsert rewrites the months of its reports
    and those where their earlier results are; other months keep their files. An output
    without months, of another origin, is appended to or rewritten as it is.
    """
    by_month = not table_exists(spark, output_table) or any(
        column == (REPORT_PARTITION, "string", True) for column in list_columns(spark, output_table)
    )
    also = (REPORT_PARTITION,) if by_month else ()
    schema = STRUCTURED_BY_MONTH if by_month else STRUCTURED_REPORTS
    chosen = select_reports(spark.read.table(reports_table), start, end, limit, also)
    rows = structured_reports(chosen, extractor, model, temperature, schema=schema)
    if upsert and by_month:
        with staging(spark) as area:
            area.write(rows, "structured")
            merge_staged(spark, area, "structured", output_table, schema, merge_all)
    elif upsert:
        replace_table(spark, merge_all(spark.read.table(output_table), rows), output_table)
    elif by_month:
        append_by_month(rows, output_table)
    else:
        append_rows(rows, output_table)
