"""The clinical tables, derived from the driver's tables by SQL both engines run.

Bad numbers, missing and blank texts, repeated keys and seconds past midnight are part
of the derivation. Every row and every whole text of the inputs takes part.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators.extract import (
    TEXT_HASH,
    active_codes,
    extract_reports,
    fetch_texts,
    one_per_accession,
    stamp,
)
from reportlake.operators.filters import Catalogue
from reportlake.schemas import RUN_DAILY
from reportlake.session import Staging
from reportlake.sources.sinks import drop_reports

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Name -> SQL. Braces name the tables it reads; both engines accept the text.
STANDINS = {
    "performed": """
        select l_orderkey as encounter_id, cast(l_linenumber as bigint) as occurrence_no,
          l_suppkey as order_no, l_partkey as procedure_code,
          cast(l_shipdate as date) as performed_date,
          case when l_orderkey % 97 = 0 then 'n/a' when l_orderkey % 89 = 0 then null
            else cast((l_orderkey * 7919 + l_linenumber * 3607) % 90000 as varchar(10)) end
            as performed_seconds,
          case when l_linestatus = 'O' then 'HSP' else 'PSC' end as source
        from {lineitem}""",
    "encounter": """
        select o_orderkey as encounter_id, o_custkey as patient_id, 'HSP' as source from {orders}
        union all
        select o_orderkey as encounter_id, o_custkey as patient_id, 'PSC' as source from {orders}""",
    "report": """
        select p.encounter_id, p.occurrence_no, p.order_no, p.source,
          case when (p.encounter_id + p.occurrence_no) % 50 = 0 then null
               when (p.encounter_id + p.occurrence_no) % 50 = 1 then '  ' || chr(10) || ' '
               else d.text end as report_text
        from (select distinct encounter_id, occurrence_no, order_no, source,
                (encounter_id * 31 + occurrence_no * 7 + order_no)
                  % (select count(*) from {documents}) as doc_id
              from {performed}) p
        join {documents} d on d.doc_id = p.doc_id""",
    "modality": """
        select distinct cast(substr(p_brand, 7) as bigint) as modality_id,
          p_brand as modality_name, cast(substr(p_brand, 7) as bigint) % 8 <> 0 as active,
          timestamp '2001-01-01 00:00:00' as created_at,
          timestamp '2001-01-01 00:00:00' as updated_at
        from {part}""",
    "vocabulary": """
        select split_part(p_name, ' ', 1) as d from {part}
        union select split_part(p_name, ' ', 2) as d from {part}
        union select p_type as d from {part}""",
    "description": """
        select cast(row_number() over (order by d) as bigint) as description_id,
          d as description, d <> 'PROMO' as active,
          timestamp '2001-01-01 00:00:00' as created_at,
          timestamp '2001-01-01 00:00:00' as updated_at
        from {vocabulary}""",
    "procedure_cat": """
        select p.p_partkey as procedure_code, p.p_name as procedure_name,
          cast(substr(p.p_brand, 7) as bigint) as modality_id,
          a.description_id as description_id_1, b.description_id as description_id_2,
          c.description_id as description_id_3,
          cast(null as bigint) as description_id_4, cast(null as bigint) as description_id_5,
          case when p.p_size % 7 = 0 then a.description_id end as description_id_6,
          cast(null as bigint) as description_id_7, p.p_size % 10 <> 0 as active,
          timestamp '2001-01-01 00:00:00' as created_at,
          timestamp '2001-01-01 00:00:00' as updated_at
        from {part} p
        join {description} a on a.description = split_part(p.p_name, ' ', 1)
        join {description} b on b.description = split_part(p.p_name, ' ', 2)
        join {description} c on c.description = p.p_type""",
    "job_metrics": """
        select cast(o_orderdate as date) as processed_date,
          case when o_orderpriority like '1%' then 'reprocessamento_historico'
               else 'job_diario' end as run_mode,
          count(*) as reports_loaded, count(distinct o_custkey) as procedures_active,
          max(o_orderdate) as run_at
        from {orders} group by 1, 2""",
    # The catalogue file: every part, its first descriptions padded or unknown here and
    # there, and a second line for a third of the codes with another modality.
    "csv_lines": """
        select 2 * p_partkey as line_no, case when p_size % 17 = 0 then null else
            p_partkey + (case when p_size % 3 = 0 then 0 else 1 end)
              * (select count(*) from {part}) end as procedure_code,
          p_name as procedure_name,
          case when p_size % 11 = 0 then 'no such modality' when p_size % 13 = 0 then null
               else lower(p_brand) end as modality,
          case when p_size % 5 = 0 then ' ' || split_part(p_name, ' ', 1) || ' '
               else split_part(p_name, ' ', 1) end as description_1,
          case when p_size % 4 = 0 then 'unheard of' else upper(split_part(p_name, ' ', 2)) end
            as description_2,
          case when p_size % 6 = 0 then '   ' else p_type end as description_3,
          'View ' || cast(p_size as varchar(5)) as description_4,
          cast(null as varchar(5)) as description_5, cast(null as varchar(5)) as description_6,
          cast(null as varchar(5)) as description_7
        from {part}
        union all
        select 2 * p_partkey + 1 as line_no,
          p_partkey + (select count(*) from {part}) as procedure_code,
          p_name || ' again' as procedure_name,
          case when p_size % 2 = 0 then p_brand else 'Extra ' || p_type end as modality,
          split_part(p_name, ' ', 1) as description_1, cast(null as varchar(5)) as description_2,
          cast(null as varchar(5)) as description_3, cast(null as varchar(5)) as description_4,
          cast(null as varchar(5)) as description_5, cast(null as varchar(5)) as description_6,
          cast(null as varchar(5)) as description_7
        from {part} where p_size <= 17""",
    # Documents with the things the text normalisation takes away.
    "messy": """
        select doc_id, '--- BEGIN REPORT ---' || chr(10) || '*** HEAD *** ' || chr(13) || chr(10)
          || '* ' || replace(text, '. ', '.' || chr(13) || chr(10) || ' 1) ') || chr(9) || '  × → '
          || chr(10) || ' ' || chr(10) || chr(9) || chr(10) || chr(10) || '- ' || chr(10)
          || '• last — line' || chr(13) || '2.  end' || chr(10) || '--- end of REPORT ---' || chr(10)
          as text
        from {documents}""",
    # Documents under the headers of a report.
    "headed": """
        select doc_id, 'EXAME: ' || source || chr(10) || 'indicação : ' || lang || chr(10)
          || chr(10) || 'ACHADOS:' || chr(10) || text || chr(10) || 'Impressão: ' || source || ' '
          || lang || '.' as text
        from {documents}""",
    # One extraction per conversation turn; the conversation is the report.
    "extraction": """
        select conv_id as doc_id, turn as pos, text as extraction_text,
          case when role = 'system' then ' Findings_Prefix '
               when (conv_id + turn) % 11 = 10 then 'other'
               when turn % 5 = 4 then 'findings_suffix' else 'findings_body' end
            as extraction_class,
          case (conv_id + turn * 7) % 5 when 0 then 'Lungs' when 1 then 'Liver'
               when 2 then 'Spine' when 3 then '' end as section,
          case (conv_id * 3 + turn) % 4 when 0 then 'normal' when 1 then 'Minor'
               when 2 then 'SIGNIFICANT' end as clinical_significance,
          case when turn % 3 = 0 then null else turn * 10 end as start_pos,
          case when turn % 4 = 3 then null else turn * 10 + 5 end as end_pos
        from {conversations}""",
}


def _needs(name: str) -> list[str]:
    text = STANDINS[name]
    return [other for other in STANDINS if "{" + other + "}" in text]


def ctes(*names: str) -> str:
    """WITH list defining the stand-ins and what they need, for DuckDB."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(name):
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    plain = {t: t for t in [*BASE, *STANDINS]}
    return ",\n".join(f"{n} as ({STANDINS[n].format(**plain)})" for n in ordered)


EXTRACTED_SQL = r"""joined as (
  select p.encounter_id, p.occurrence_no, p.order_no,
    p.encounter_id::varchar || p.occurrence_no::varchar || p.order_no::varchar as accession_number,
    p.procedure_code, e.o_custkey as patient_id, r.report_text,
    p.performed_date::timestamp
      + to_microseconds((coalesce(try_cast(p.performed_seconds as double), 0) * 1000000)::bigint)
      as performed_at,
    r.source, strftime(p.performed_date, '%Y-%m') as year_month, p.source as performed_source,
    p.performed_date
  from performed p
  join procedure_cat c on c.procedure_code = p.procedure_code and c.active
  join orders e on e.o_orderkey = p.encounter_id
  join report r on r.encounter_id = p.encounter_id and r.occurrence_no = p.occurrence_no
    and r.order_no = p.order_no
  where regexp_matches(r.report_text, '\S')),
reports as (
  select * exclude (performed_source, performed_date) from joined
  qualify row_number() over (partition by accession_number order by source, encounter_id,
    occurrence_no, order_no, procedure_code, patient_id, performed_at) = 1)"""


def with_reports(*names: str) -> str:
    return f"with {ctes('performed', 'report', 'procedure_cat', *names)},\n{EXTRACTED_SQL}\n"


def with_standins(*names: str) -> str:
    return f"with {ctes(*names)}\n"


class Data:
    """The stand-ins as DataFrames of one data folder; everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in STANDINS:
            return self.base(name)
        text = STANDINS[name]
        used = {t: self.table(t) for t in [*BASE, *STANDINS] if "{" + t + "}" in text}
        if name == "report":
            # Its keys hardly repeat, so a map of them in front of the shuffle only takes memory; gathered
            # like this the rows are distinct in place, and meet their encounters there if documents are sent.
            used["performed"] = used["performed"].repartition("encounter_id", "source")
        return self.spark.sql(text, **used)

    @cached_property
    def performed(self) -> DataFrame:
        return self.table("performed")

    @cached_property
    def catalogue(self) -> Catalogue:
        return Catalogue(
            self.table("modality"), self.table("description"), self.table("procedure_cat")
        )

    def joined(self, start=None, end=None, strict_source=False, strict_key=False, of_text=None) -> DataFrame:
        """For who needs columns of the text, ``of_text``, or none; see ``with_texts``."""
        return extract_reports(
            self.performed,
            self.table("encounter"),
            self.table("report"),
            active_codes(self.catalogue.procedures),
            start,
            end,
            strict_source,
            strict_key,
            of_text or {},
        )

    @cached_property
    def reports(self) -> DataFrame:
        return one_per_accession(self.joined())

    def with_texts(self, start=None, end=None) -> DataFrame:
        """The same rows for who needs the texts: these are fetched when the rows are chosen, and moved once."""
        chosen = one_per_accession(self.joined(start, end, of_text={TEXT_HASH: F.xxhash64("report_text")}), keep_hash=True)
        return fetch_texts(chosen.drop("report_text"), self.table("report"))

    def stamped(self, loaded_at: str, rows: DataFrame | None = None, mode: str = RUN_DAILY):
        return stamp(
            self.reports if rows is None else rows, mode, F.lit(loaded_at).cast("timestamp")
        )


@contextmanager
def own_table(data: Data):
    """The name of a table that is gone afterwards."""
    name = f"checks_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        drop_reports(data.spark, name)


def kept(data: Data, rows: DataFrame) -> DataFrame:
    """A copy that outlives the table it was read from."""
    return Staging(data.spark).write(rows, "rows")
