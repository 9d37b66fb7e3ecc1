"""Extraction, deduplication and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.registry import day_sql, query, stamp_sql
from checks.standins import Data, with_reports, with_standins
from reportlake.operators.extract import (
    active_codes,
    active_procedures,
    attach_reports,
    in_window,
    key_collisions,
    one_per_accession,
    performed_in_window,
    stamp,
    union_systems,
)
from reportlake.operators.upsert import merge_all, merge_daily
from reportlake.functions.scalars import non_blank
from reportlake.plans.backfill import batch_windows_frame, dry_run_by_batch
from reportlake.schemas import RUN_DAILY, RUN_REPROCESS, SOURCES

PERFORMED_COLUMNS = f"""encounter_id, occurrence_no, order_no, procedure_code,
  {day_sql('performed_date')} as performed_date, performed_seconds, source"""

REPORT_COLUMNS = f"""encounter_id, occurrence_no, order_no, accession_number, procedure_code,
  patient_id, md5(report_text) as text_md5, length(report_text) as text_chars,
  {stamp_sql('performed_at')} as performed_at, source, year_month"""

T0, T1 = "2001-01-01 00:00:00", "2001-02-01 00:00:00"


TEXT_MD5 = "text_md5"


def md5_bytes(text: str | Column) -> Column:
    """The digest as 16 bytes, half of what its hex digits take on the way."""
    return F.unhex(F.md5(text))


def hex_digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest() -> dict[str, Column]:
    """The whole text as its digest and length, to keep the comparison small."""
    return {TEXT_MD5: md5_bytes("report_text"), "text_chars": F.char_length("report_text")}


def with_digest(rows: DataFrame) -> DataFrame:
    """Rows with the digest in place of the text; it may be there already, made where the text was read."""
    made = {name: column for name, column in digest().items() if name not in rows.columns}
    digested = rows.withColumns(made).withColumn(TEXT_MD5, hex_digits(F.col(TEXT_MD5)))
    return digested.drop("report_text", "text_hash")


@query("performed_scan", with_standins("performed") + f"select {PERFORMED_COLUMNS} from performed")
def _(data: Data) -> DataFrame:
    return data.performed


@query(
    "systems_union", with_standins("performed") + f"select {PERFORMED_COLUMNS} from performed"
)
def _(data: Data) -> DataFrame:
    systems = {s: data.performed.filter(F.col("source") == s).drop("source") for s in SOURCES}
    return union_systems(systems)


@query(
    "active_procedures",
    with_standins("procedure_cat", "modality")
    + """select p.procedure_code, p.procedure_name, m.modality_name
         from procedure_cat p join modality m using (modality_id)
         where p.active order by p.procedure_code""",
)
def _(data: Data) -> DataFrame:
    return active_procedures(data.catalogue.procedures, data.catalogue.modalities)


@query(
    "performed_in_window",
    with_standins("performed", "procedure_cat")
    + f"""select {PERFORMED_COLUMNS} from performed
          where procedure_code in (select procedure_code from procedure_cat where active)
            and performed_date >= date '1996-01-01' and performed_date < date '1997-03-01'""",
)
def _(data: Data) -> DataFrame:
    codes = active_codes(data.catalogue.procedures)
    return performed_in_window(data.performed, codes, "1996-01-01", "1997-03-01")


@query(
    "performed_with_patient",
    with_standins("performed", "encounter")
    + """select p.encounter_id, p.occurrence_no, p.order_no, p.procedure_code, p.source, e.patient_id
         from performed p join encounter e
           on e.encounter_id = p.encounter_id and e.source = p.source""",
)
def _(data: Data) -> DataFrame:
    return data.performed.join(data.table("encounter"), ["encounter_id", "source"]).select(
        "encounter_id", "occurrence_no", "order_no", "procedure_code", "source", "patient_id"
    )


@query(
    "usable_texts",
    with_standins("performed", "report")
    + r"""select encounter_id, occurrence_no, order_no, source, md5(report_text) as text_md5,
            length(report_text) as text_chars
          from report where report_text is not null and regexp_matches(report_text, '\S')""",
)
def _(data: Data) -> DataFrame:
    return with_digest(data.table("report").filter(non_blank("report_text")))


@query(
    "performed_with_report",
    with_reports("encounter")
    + """select encounter_id, occurrence_no, order_no, procedure_code, source, patient_id,
           md5(report_text) as text_md5, length(report_text) as text_chars from joined""",
)
def _(data: Data) -> DataFrame:
    codes = active_codes(data.catalogue.procedures)
    joined = attach_reports(
        performed_in_window(data.performed, codes), data.table("encounter"), data.table("report"), of_text=digest()
    )
    return with_digest(joined).drop("performed_date", "performed_seconds")


@query("extracted_rows", with_reports() + f"select {REPORT_COLUMNS} from joined")
def _(data: Data) -> DataFrame:
    return with_digest(data.joined(of_text=digest()))


@query(
    "extracted_rows_strict_source",
    with_reports() + f"select {REPORT_COLUMNS} from joined where source = performed_source",
)
def _(data: Data) -> DataFrame:
    return with_digest(data.joined(strict_source=True, of_text=digest()))


@query(
    "extracted_rows_in_window",
    with_reports()
    + f"""select {REPORT_COLUMNS} from joined
          where performed_date >= date '1997-01-01' and performed_date < date '1997-07-01'""",
)
def _(data: Data) -> DataFrame:
    return with_digest(data.joined("1997-01-01", "1997-07-01", of_text=digest()))


@query("deduplicated_reports", with_reports() + f"select {REPORT_COLUMNS} from reports")
def _(data: Data) -> DataFrame:
    return with_digest(one_per_accession(data.joined(of_text=digest())))


@query(
    "deduplicated_reports_strict_key",
    with_reports()
    + f"""select {REPORT_COLUMNS.replace('accession_number,', "accession_number,", 1)}
          from (select * replace (encounter_id::varchar || '-' || occurrence_no::varchar || '-'
                  || order_no::varchar as accession_number) from joined)
          qualify row_number() over (partition by accession_number order by source, encounter_id,
            occurrence_no, order_no, procedure_code, patient_id, performed_at) = 1""",
)
def _(data: Data) -> DataFrame:
    return with_digest(one_per_accession(data.joined(strict_key=True, of_text=digest())))


@query(
    "key_collisions",
    with_reports()
    + """select accession_number, count(*) as triples
         from (select distinct accession_number, encounter_id, occurrence_no, order_no from joined)
         group by 1 having count(*) > 1""",
)
def _(data: Data) -> DataFrame:
    return key_collisions(data.joined())


@query(
    "stamped_reports",
    with_reports()
    + f"""select accession_number, year_month, '{T0}' as loaded_at, 'job_diario' as run_mode
          from reports""",
)
def _(data: Data) -> DataFrame:
    return data.stamped(T0).select("accession_number", "year_month", "loaded_at", "run_mode")


# Target: everything before 1999, with other texts. Batch: everything since 1998.
MERGE_SQL = (
    with_reports()
    + f""", narrow as (select *, 'earlier: ' || report_text as old_text from joined),
  target as (select * from narrow where performed_date < date '1999-01-01'
    qualify row_number() over (partition by accession_number order by source, encounter_id,
      occurrence_no, order_no, procedure_code, patient_id, performed_at) = 1),
  batch as (select * from narrow where performed_date >= date '1998-01-01'
    qualify row_number() over (partition by accession_number order by source, encounter_id,
      occurrence_no, order_no, procedure_code, patient_id, performed_at) = 1),
  pairs as (select t.accession_number is not null as old, b.accession_number is not null as new,
      coalesce(t.accession_number, b.accession_number) as accession_number,
      t.procedure_code as t_code, b.procedure_code as b_code,
      t.patient_id as t_patient, b.patient_id as b_patient,
      t.performed_at as t_at, b.performed_at as b_at, t.year_month as t_month,
      b.year_month as b_month, t.source as t_source, b.source as b_source,
      t.old_text as t_text, b.report_text as b_text
    from target t full outer join batch b on b.accession_number = t.accession_number)
"""
)


def _merged_sql(other: str) -> str:
    """``other`` decides the columns a daily run leaves alone."""
    return MERGE_SQL + f"""select accession_number,
      case when {other} then b_code else t_code end as procedure_code,
      case when {other} then b_patient else t_patient end as patient_id,
      md5(case when new then b_text else t_text end) as text_md5,
      {stamp_sql(f'case when {other} then b_at else t_at end')} as performed_at,
      case when {other} then b_source else t_source end as source,
      case when {other} then b_month else t_month end as year_month,
      case when new then '{T1}' else '{T0}' end as loaded_at,
      case when {other} then 'reprocessamento_historico' else 'job_diario' end as run_mode
    from pairs"""


def _earlier() -> Column:
    return F.concat(F.lit("earlier: "), "report_text")


def merge_sides(data: Data) -> tuple[DataFrame, DataFrame]:
    """Target and batch with their texts."""
    old = data.with_texts(end="1999-01-01").withColumn("report_text", _earlier())
    return _stamped_sides(old, data.with_texts(start="1998-01-01"))


def digested_sides(data: Data) -> tuple[DataFrame, DataFrame]:
    """The same with the digest of the texts beside them, made where a text is read."""
    old = one_per_accession(data.joined(end="1999-01-01", of_text={TEXT_MD5: md5_bytes(_earlier())}))
    new = one_per_accession(data.joined(start="1998-01-01", of_text={TEXT_MD5: md5_bytes("report_text")}))
    return _stamped_sides(old.withColumn("report_text", _earlier()), new)


def _stamped_sides(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    also = [c for c in old.columns if c == TEXT_MD5]
    return (
        stamp(old, RUN_DAILY, F.lit(T0).cast("timestamp"), also),
        stamp(new, RUN_REPROCESS, F.lit(T1).cast("timestamp"), also),
    )


def _merge_view(merged: DataFrame) -> DataFrame:
    digest = F.col(TEXT_MD5) if TEXT_MD5 in merged.columns else md5_bytes("report_text")
    return merged.select(
        "accession_number",
        "procedure_code",
        "patient_id",
        hex_digits(digest).alias(TEXT_MD5),
        "performed_at",
        "source",
        "year_month",
        "loaded_at",
        "run_mode",
    )


@query("upsert_daily", _merged_sql("not old"))
def _(data: Data) -> DataFrame:
    return _merge_view(merge_daily(*digested_sides(data), of_text=[TEXT_MD5]))


@query("upsert_daily_by_lookup", _merged_sql("not old"))
def _(data: Data) -> DataFrame:
    return _merge_view(merge_daily(*digested_sides(data), small_source=True, of_text=[TEXT_MD5]))


@query("upsert_reprocess", _merged_sql("new"))
def _(data: Data) -> DataFrame:
    return _merge_view(merge_all(*digested_sides(data)))


@query("upsert_reprocess_by_lookup", _merged_sql("new"))
def _(data: Data) -> DataFrame:
    return _merge_view(merge_all(*digested_sides(data), small_source=True))


@query(
    "reports_open_window",
    with_reports()
    + f"""select accession_number, {stamp_sql('performed_at')} as performed_at from reports
          where performed_at >= timestamp '1998-06-01'""",
)
def _(data: Data) -> DataFrame:
    rows = data.reports.filter(in_window("performed_at", "1998-06-01", None))
    return rows.select("accession_number", "performed_at")


@query(
    "batch_windows",
    with_standins("performed")
    + f""", span as (select min(performed_date) as first, max(performed_date) + 1 as past
            from performed)
          select row_number() over (order by s) as batch, {day_sql('s')} as period_start,
            {day_sql('least(s + 14, past)')} as period_end
          from (select unnest(range(0, (past - first)::bigint, 14))::integer + first as s, past
                from span)""",
)
def _(data: Data) -> DataFrame:
    span = data.performed.agg(
        F.min("performed_date").alias("start"), F.date_add(F.max("performed_date"), 1).alias("end")
    )
    return batch_windows_frame(span, 14)


@query(
    "dry_run_by_batch",
    with_reports()
    + """select ((performed_date - date '1995-01-01') // 30 + 1)::bigint as batch,
           count(*) as rows, count(distinct accession_number) as accessions,
           count(distinct procedure_code) as procedures, count(distinct patient_id) as patients
         from joined where performed_date >= date '1995-01-01'
           and performed_date < date '1996-01-01' group by 1""",
)
def _(data: Data) -> DataFrame:
    windowed = attach_reports(
        performed_in_window(
            data.performed, active_codes(data.catalogue.procedures), "1995-01-01", "1996-01-01"
        ),
        data.table("encounter"),
        data.table("report"),
    )
    return dry_run_by_batch(windowed, "1995-01-01", 30)
