"""One StructType per table; readers pass it and writers select to it."""

from __future__ import annotations

from pyspark.sql import types as T

# Source tags, run-mode codes and the number of description slots.
SOURCE_HOSPITAL = "HSP"
SOURCE_EMERGENCY = "PSC"
SOURCES = (SOURCE_HOSPITAL, SOURCE_EMERGENCY)
RUN_DAILY = "job_diario"
RUN_REPROCESS = "reprocessamento_historico"
SLOTS = 7

SLOT_COLUMNS = tuple(f"description_id_{i}" for i in range(1, SLOTS + 1))
SLOT_NAMES = tuple(f"description_{i}" for i in range(1, SLOTS + 1))


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str, required: tuple[str, ...] = ()) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType(
        [T.StructField(name, _TYPES[kind], name not in required) for name, kind in pairs]
    )


PERFORMED = _struct(
    "encounter_id bigint, occurrence_no bigint, order_no bigint, procedure_code bigint, "
    "performed_date date, performed_seconds string, source string"
)
ENCOUNTERS = _struct("encounter_id bigint, patient_id bigint, source string")
REPORT_TEXTS = _struct(
    "encounter_id bigint, occurrence_no bigint, order_no bigint, report_text string, source string"
)

REPORTS = _struct(
    "encounter_id bigint, occurrence_no bigint, order_no bigint, accession_number string, "
    "procedure_code bigint, patient_id bigint, report_text string, performed_at timestamp, "
    "source string, loaded_at timestamp, run_mode string, year_month string",
    required=("accession_number",),
)
REPORT_KEY = "accession_number"
REPORT_PARTITION = "year_month"
# Table property and column metadata: months that performed_at may lie behind year_month.
MONTH_SLACK = "reportlake.month_slack"

MODALITIES = _struct(
    "modality_id bigint, modality_name string, active boolean, "
    "created_at timestamp, updated_at timestamp",
    required=("modality_name",),
)
DESCRIPTIONS = _struct(
    "description_id bigint, description string, active boolean, "
    "created_at timestamp, updated_at timestamp",
    required=("description",),
)
PROCEDURES = _struct(
    "procedure_code bigint, procedure_name string, modality_id bigint, "
    + ", ".join(f"{c} bigint" for c in SLOT_COLUMNS)
    + ", active boolean, created_at timestamp, updated_at timestamp",
    required=("procedure_code", "procedure_name", "modality_id"),
)
RUN_MODES = _struct("code string, active boolean")

JOB_METRICS = _struct(
    "processed_date date, period_start date, period_end date, run_mode string, "
    "procedures_active bigint, procedures_performed bigint, reports_loaded bigint, "
    "total_reports bigint, run_at timestamp"
)
BATCH_RESULTS = _struct(
    "batch int, period_start date, period_end date, status string, performed bigint, "
    "reports_found bigint, reports_loaded bigint, distinct_accessions bigint, "
    "distinct_procedures bigint, distinct_patients bigint, seconds double, error string, "
    "scan_error string"
)
BATCH_LEDGER = _struct(
    "reports_table string, period_start date, period_end date, source_version string, "
    "status string, reports_loaded bigint, finished_at timestamp"
)

# Nested shapes, as type strings for cast / from_json / pandas_udf.
INTERVALS = "array<struct<startPos:int,endPos:int>>"
SEGMENT = (
    f"struct<type:string,label:string,content:string,intervals:{INTERVALS},significance:string>"
)
EXTRACTION = (
    "struct<extraction_text:string,extraction_class:string,attributes:map<string,string>,"
    "char_interval:struct<start_pos:int,end_pos:int>,alignment_status:string>"
)
EXTRACTIONS = f"array<{EXTRACTION}>"

STRUCTURED_REPORTS = _struct(
    "accession_number string, segments_json string, annotated_document_json string, "
    "formatted_text string, raw_prompt string, model string, temperature double, "
    "loaded_at timestamp"
)
# As a table: in the months of the reports.
STRUCTURED_BY_MONTH = T.StructType([*STRUCTURED_REPORTS.fields, REPORTS[REPORT_PARTITION]])

# Header names of the catalogue file (fixed values) and the columns they become.
CSV_HEADERS = (
    "CD_PROCEDIMENTO",
    "NM_PROCEDIMENTO",
    "MODALIDADE",
    "DESCRICAO_1",
    "DESCRICAO_2",
    "DESCRICAO_3",
    "DESCRICAO_4",
    "DESCRICAO_5",
    "DESCRICAO_6",
    "DESCRICAO_7",
)
CSV_COLUMNS = ("procedure_code", "procedure_name", "modality", *SLOT_NAMES)
