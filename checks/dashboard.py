"""Dashboard and monitoring queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import day_sql, query, stamp_sql
from checks.standins import Data, with_reports, with_standins
from reportlake.operators.catalog import DESCRIPTION, MODALITY, name_options
from reportlake.operators.extract import active_procedures
from reportlake.operators.filters import Filters, filtered_reports
from reportlake.plans import dashboard, monitoring
from reportlake.schemas import RUN_DAILY, RUN_REPROCESS

WITH = with_reports("modality", "description")

STAR = """from reports l
  join procedure_cat p on p.procedure_code = l.procedure_code
  join modality m on m.modality_id = p.modality_id"""
ANY_SLOT = """d.description_id in (p.description_id_1, p.description_id_2, p.description_id_3,
    p.description_id_4, p.description_id_5, p.description_id_6, p.description_id_7)"""
STAR_DESCRIBED = f"{STAR} left join description d on {ANY_SLOT}"
ACTIVE = "p.active and m.active"
TODAY = "(select max(performed_date) from performed)"

MODALITIES = ["Brand#2", "Brand#5", "Brand#16", "Brand#19"]
DESCRIPTIONS = ["red", "ECONOMY", "PROMO"]
PICKED_MODALITIES = "m.modality_name in ('Brand#2', 'Brand#5', 'Brand#16', 'Brand#19')"
PICKED_DESCRIPTIONS = "d.description in ('red', 'ECONOMY', 'PROMO')"


def today(data: Data):
    return data.performed.agg(F.max("performed_date")).scalar()


# Filter combinations: name -> (filters of the data, FROM, WHERE).
SHAPES = {
    "all": (lambda data: Filters(), "from reports l", "true"),
    "one_source": (
        lambda data: Filters(sources=["HSP"]),
        "from reports l",
        "l.source in ('HSP')",
    ),
    "no_source": (lambda data: Filters(sources=[]), "from reports l", "false"),
    "last_365_days": (
        lambda data: Filters(last_days=365, as_of=today(data), sources=["HSP", "PSC"]),
        "from reports l",
        f"l.performed_at >= {TODAY} - 365 and l.source in ('HSP', 'PSC')",
    ),
    "last_90_days_pruned": (
        lambda data: Filters(last_days=90, as_of=today(data), month_slack=1),
        "from reports l",
        f"l.performed_at >= {TODAY} - 90",
    ),
    "modalities": (
        lambda data: Filters(modalities=MODALITIES),
        STAR_DESCRIBED,
        f"{ACTIVE} and {PICKED_MODALITIES}",
    ),
    "all_modalities": (
        lambda data: Filters(modalities=MODALITIES, modality_options=MODALITIES),
        "from reports l",
        "true",
    ),
    "descriptions": (
        lambda data: Filters(descriptions=DESCRIPTIONS),
        STAR_DESCRIBED,
        f"{ACTIVE} and {PICKED_DESCRIPTIONS}",
    ),
    "everything": (
        lambda data: Filters(
            last_days=1000,
            as_of=today(data),
            sources=["PSC"],
            modalities=MODALITIES,
            descriptions=DESCRIPTIONS,
        ),
        STAR_DESCRIBED,
        f"""l.performed_at >= {TODAY} - 1000 and l.source in ('PSC') and {ACTIVE}
            and {PICKED_MODALITIES} and {PICKED_DESCRIPTIONS}""",
    ),
}

R = "count(distinct l.accession_number) as reports"
P = "count(distinct l.patient_id) as patients"
C = "count(distinct l.procedure_code) as procedures"


def _kpi(source: str, where: str) -> str:
    return f"""select reports, reports as unique_reports, patients, procedures, days,
        {stamp_sql('first_at')} as first_at, {stamp_sql('last_at')} as last_at,
        reports::double / greatest(days, 1) as mean_per_day
      from (select {R}, {P}, {C}, count(distinct l.performed_at::date) as days,
        min(l.performed_at) as first_at, max(l.performed_at) as last_at
        {source} where {where})"""


def _daily(source: str, where: str) -> str:
    return f"""select {day_sql('s.day')} as day, coalesce(n.reports, 0) as reports,
        coalesce(n.patients, 0) as patients
      from (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day
            from (select l.performed_at::date as day {source} where {where})) s
      left join (select l.performed_at::date as day, {R}, {P} {source} where {where} group by 1) n
        on n.day = s.day"""


def _by_source(source: str, where: str) -> str:
    return f"select l.source, {R}, {P}, {C} {source} where {where} group by 1"


def _by_weekday(source: str, where: str) -> str:
    return f"""select (dayofweek(l.performed_at) + 1)::bigint as weekday,
        ['Domingo', 'Segunda', 'Terça', 'Quarta', 'Quinta', 'Sexta', 'Sábado']
          [dayofweek(l.performed_at) + 1] as weekday_name, {R},
        avg(count(distinct l.accession_number)) over () as mean
      {source} where {where} group by dayofweek(l.performed_at)"""


def _by_hour(source: str, where: str) -> str:
    return f"select hour(l.performed_at)::bigint as hour, {R} {source} where {where} group by 1"


UNDIMENSIONED = {
    "kpi_row": (dashboard.kpi_row, _kpi),
    "daily_volume": (dashboard.daily_volume, _daily),
    "by_source": (dashboard.by_source, _by_source),
    "by_weekday": (dashboard.by_weekday, _by_weekday),
    "by_hour": (dashboard.by_hour, _by_hour),
}


def _run(build, shape: str, data: Data) -> DataFrame:
    return build(data.reports, data.catalogue, SHAPES[shape][0](data))


for _name, (_build, _sql) in UNDIMENSIONED.items():
    for _shape, (_filters, _from, _where) in SHAPES.items():
        if _name == "kpi_row" or _shape in ("all", "descriptions", "last_365_days"):
            query(f"{_name}_{_shape}", WITH + _sql(_from, _where))(partial(_run, _build, _shape))

# The dimensioned queries join the catalogue whatever the filters are.
_JOINED = {
    "all": (STAR, ACTIVE),
    "modalities": (STAR, f"{ACTIVE} and {PICKED_MODALITIES}"),
    "descriptions": (STAR_DESCRIBED, f"{ACTIVE} and {PICKED_DESCRIPTIONS}"),
    "everything": (STAR_DESCRIBED, SHAPES["everything"][2]),
}
_DIMENSIONED = {
    "top_modalities": (
        dashboard.top_modalities,
        lambda f, w: f"""select m.modality_name, {R}, {P} {f} where {w} group by 1
            order by reports desc, 1 limit 10""",
    ),
    "top_procedures": (
        dashboard.top_procedures,
        lambda f, w: f"""select p.procedure_code, p.procedure_name, {R}, {P},
            substr(p.procedure_name, 1, 50) || '...' as label {f} where {w} group by 1, 2
            order by reports desc, 1 limit 10""",
    ),
    "modality_detail": (
        dashboard.modality_detail,
        lambda f, w: f"""select m.modality_name, {R}, {P}, {C},
            round(count(distinct l.accession_number)::double * 100.0
              / sum(count(distinct l.accession_number)) over (), 2) as share
            {f} where {w} group by 1""",
    ),
}
for _name, (_build, _sql) in _DIMENSIONED.items():
    for _shape, (_from, _where) in _JOINED.items():
        query(f"{_name}_{_shape}", WITH + _sql(_from, _where))(partial(_run, _build, _shape))

for _shape, _extra in {
    "all": "true",
    "modalities": PICKED_MODALITIES,
    "descriptions": PICKED_DESCRIPTIONS,
    "everything": SHAPES["everything"][2],
}.items():
    query(
        f"top_descriptions_{_shape}",
        WITH
        + f"""select d.description, {R}, {P}, substr(d.description, 1, 50) || '...' as label
          {STAR} join description d on {ANY_SLOT}
          where {ACTIVE} and d.active and {_extra}
          group by 1 order by reports desc, 1 limit 10""",
    )(partial(_run, dashboard.top_descriptions, _shape))


@query(
    "reports_of_picked_descriptions",
    WITH
    + f"""select distinct l.accession_number, l.procedure_code {STAR_DESCRIBED}
      where {ACTIVE} and {PICKED_DESCRIPTIONS}""",
)
def _(data: Data) -> DataFrame:
    picked = filtered_reports(data.reports, data.catalogue, Filters(descriptions=DESCRIPTIONS))
    return picked.select("accession_number", "procedure_code")


METRICS = with_standins("job_metrics")


@query(
    "last_runs",
    METRICS
    + f"""select {day_sql('processed_date')} as processed_date, run_mode, reports_loaded,
        procedures_active, strftime(run_at, '%d/%m/%Y %H:%M') as run_time
      from job_metrics order by run_at desc, run_mode limit 10""",
)
def _(data: Data) -> DataFrame:
    return dashboard.last_runs(data.table("job_metrics"))


@query(
    "load_statistics",
    METRICS
    + """select run_mode, count(*) as runs, sum(reports_loaded)::bigint as total_reports,
        round_even(avg(reports_loaded), 0) as mean_reports, max(reports_loaded) as max_reports
      from job_metrics group by 1""",
)
def _(data: Data) -> DataFrame:
    return dashboard.load_statistics(data.table("job_metrics"))


for _k in (1, 5):
    query(
        f"recent_runs_{_k}",
        METRICS
        + f"""select {day_sql('processed_date')} as processed_date, run_mode, reports_loaded,
            procedures_active, {stamp_sql('run_at')} as run_at
          from job_metrics order by job_metrics.run_at desc, run_mode limit {_k}""",
    )(lambda data, k=_k: monitoring.recent_runs(data.table("job_metrics"), k))


RANGE = f"{stamp_sql('min(performed_at)')} as first_at, {stamp_sql('max(performed_at)')} as last_at"
DISTINCTS = """count(distinct accession_number) as accessions,
  count(distinct procedure_code) as procedures, count(distinct patient_id) as patients"""


@query(
    "extraction_statistics",
    with_reports() + f"select count(*) as rows, {DISTINCTS}, {RANGE} from joined",
)
def _(data: Data) -> DataFrame:
    return monitoring.extraction_statistics(data.joined())


@query(
    "top_codes",
    with_reports()
    + """select procedure_code, count(*) as rows from reports group by 1
         order by rows desc, 1 limit 10""",
)
def _(data: Data) -> DataFrame:
    return monitoring.top_codes(data.reports)


@query(
    "active_modality_count",
    with_standins("procedure_cat", "modality")
    + """select count(distinct m.modality_name) as modalities
         from procedure_cat p join modality m using (modality_id) where p.active""",
)
def _(data: Data) -> DataFrame:
    active = active_procedures(data.catalogue.procedures, data.catalogue.modalities)
    return monitoring.modality_count(active)


@query("total_reports", with_reports() + "select count(*) as total from reports")
def _(data: Data) -> DataFrame:
    return monitoring.total_rows(data.reports)


# Reports since 1998 as reprocessed, the others as loaded daily; loaded a day after.
LOADED = (
    with_reports()
    + """, loaded as (select *,
      case when year_month >= '1998-01' then 'reprocessamento_historico' else 'job_diario' end
        as run_mode, performed_at::date + interval 1 day as loaded_at from reports)
"""
)


def loaded(data: Data) -> DataFrame:
    mode = F.when(F.col("year_month") >= "1998-01", RUN_REPROCESS).otherwise(RUN_DAILY)
    day_after = F.date_add(F.to_date("performed_at"), 1).cast("timestamp")
    return data.reports.withColumns({"run_mode": mode, "loaded_at": day_after})


for _column in ("performed_at", "loaded_at"):
    query(
        f"month_verification_by_{_column}",
        LOADED
        + f"""select year_month, count(*) as rows,
            count(distinct accession_number) as accessions, {RANGE}
          from loaded where run_mode = 'reprocessamento_historico'
            and {_column} >= date '1998-01-01' and {_column} < date '1999-01-01' group by 1""",
    )(
        lambda data, c=_column: monitoring.month_verification(
            loaded(data), RUN_REPROCESS, "1998-01-01", "1999-01-01", c
        )
    )


@query(
    "duplicate_keys",
    with_reports()
    + """select accession_number, count(*) as rows from joined group by 1 having count(*) > 1""",
)
def _(data: Data) -> DataFrame:
    return monitoring.duplicate_keys(data.joined())


@query("dry_run_statistics", with_reports() + f"select {DISTINCTS} from joined")
def _(data: Data) -> DataFrame:
    return monitoring.dry_run_statistics(data.joined())


@query(
    "timestamp_completeness",
    with_reports()
    + f"""select count(*) as rows, count(performed_at) as with_timestamp, {RANGE}
          from reports""",
)
def _(data: Data) -> DataFrame:
    return monitoring.timestamp_completeness(data.reports)


@query(
    "volume_by_load",
    LOADED
    + f"""select {day_sql('loaded_at')} as load_day, run_mode, count(*) as rows, {DISTINCTS}
          from loaded group by 1, 2""",
)
def _(data: Data) -> DataFrame:
    return monitoring.volume_by_load(loaded(data))


@query(
    "volume_by_month",
    with_reports()
    + """select year(performed_at)::bigint as year, month(performed_at)::bigint as month,
           count(*) as rows from reports group by 1, 2""",
)
def _(data: Data) -> DataFrame:
    return monitoring.volume_by_month(data.reports)


@query(
    "volume_by_source",
    with_reports()
    + f"""select source, count(*) as rows, count(distinct patient_id) as patients, {RANGE}
          from reports group by 1""",
)
def _(data: Data) -> DataFrame:
    return monitoring.volume_by_source(data.reports)


@query(
    "modality_load_volume",
    LOADED
    + f""", names as (select distinct cast(substr(p_brand, 7) as bigint) as modality_id,
            p_brand as modality_name from part),
          catalogue as (select p.procedure_code, m.modality_name from procedure_cat p
            join names m on m.modality_id = p.modality_id)
          select modality_name, count(*) as rows, count(distinct accession_number) as accessions
          from loaded l join catalogue using (procedure_code)
          where loaded_at >= {TODAY} - 30 group by 1""",
)
def _(data: Data) -> DataFrame:
    return monitoring.modality_load_volume(loaded(data), data.catalogue, 30, today(data))


SAMPLE = f"""accession_number, encounter_id, occurrence_no, order_no, procedure_code,
  {stamp_sql('performed_at')} as performed_at, year_month"""


@query(
    "sample_reports",
    with_reports() + f"select {SAMPLE} from reports order by accession_number limit 10",
)
def _(data: Data) -> DataFrame:
    return monitoring.sample_reports(data.reports)


@query(
    "loaded_on_day",
    LOADED
    + f"""select {SAMPLE} from loaded where loaded_at::date = date '1997-05-05'
          order by accession_number limit 10""",
)
def _(data: Data) -> DataFrame:
    return monitoring.loaded_on(loaded(data), F.lit("1997-05-05").cast("date"))


@query(
    "modality_options",
    with_standins("modality")
    + "select distinct modality_name from modality where active order by 1",
)
def _(data: Data) -> DataFrame:
    return name_options(data.catalogue.modalities, MODALITY)


@query(
    "description_options",
    with_standins("description")
    + "select distinct description from description where active order by 1",
)
def _(data: Data) -> DataFrame:
    return name_options(data.catalogue.descriptions, DESCRIPTION)
