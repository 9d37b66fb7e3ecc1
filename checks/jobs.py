"""The jobs and sinks through real tables and files of the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.extraction import MERGE_SQL, REPORT_COLUMNS, T0, _merge_view, _merged_sql, merge_sides, with_digest
from checks.dashboard import today
from checks.registry import ORACLES, day_sql, query
from checks.standins import Data, kept, own_table, with_reports, with_standins
from reportlake.operators.csv_import import read_catalogue_csv
from reportlake.operators.filters import Filters
from reportlake.plans import dashboard
from reportlake.plans.backfill import run_backfill
from reportlake.plans.daily import run_daily
from reportlake.plans.monitoring import backfill_summary
from reportlake.schemas import CSV_COLUMNS, CSV_HEADERS, RUN_DAILY, RUN_MODES, RUN_REPROCESS
from reportlake.session import Staging
from reportlake.sources.sinks import compact_reports, create_reports, keys_table, read_reports, upsert_reports
from reportlake.sources.systems import SourceTables

DAYS = 365


def _sources(data: Data) -> SourceTables:
    return SourceTables(data.performed, data.table("encounter"), data.table("report"))


def _modes(data: Data) -> DataFrame:
    return data.spark.createDataFrame([(RUN_DAILY, True), (RUN_REPROCESS, True)], RUN_MODES)


for _mode, _name, _other in ((RUN_DAILY, "daily", "not old"), (RUN_REPROCESS, "reprocess", "new")):

    def _through_table(data: Data, mode=_mode) -> DataFrame:
        old, new = merge_sides(data)
        with own_table(data) as table:
            create_reports(old, table)
            upsert_reports(data.spark, new, table, mode)
            compact_reports(data.spark, table)
            return kept(data, _merge_view(data.spark.read.table(table)))

    query(f"upsert_through_table_{_name}", _merged_sql(_other))(_through_table)


# Where the keys live, as the table beside the reports has it after a merge and a compaction.
@query(
    "months_of_keys",
    MERGE_SQL + "select accession_number, case when new then b_month else t_month end as year_month from pairs",
)
def _(data: Data) -> DataFrame:
    old, new = merge_sides(data)
    with own_table(data) as table:
        create_reports(old, table)
        upsert_reports(data.spark, new, table, RUN_REPROCESS)
        compact_reports(data.spark, table)
        return kept(data, data.spark.read.table(keys_table(table)).drop("bucket"))


@query("clustered_reports", with_reports() + f"select {REPORT_COLUMNS} from reports")
def _(data: Data) -> DataFrame:
    with own_table(data) as table:
        create_reports(data.stamped(T0, data.with_texts()), table)
        compact_reports(data.spark, table, cluster_by=("accession_number", "procedure_code", "performed_at"))
        return kept(data, with_digest(data.spark.read.table(table).drop("loaded_at", "run_mode")))


# The period prunes months by what the table says of itself.
for _period in ("kpi_row_last_90_days_pruned", "by_source_last_365_days"):

    @query(f"{_period.replace('_pruned', '')}_of_table", ORACLES[_period])
    def _(data: Data, period=_period) -> DataFrame:
        with own_table(data) as table:
            create_reports(data.stamped(T0, data.with_texts()), table)
            reports = read_reports(data.spark, table)
            if period.startswith("kpi_row"):
                return kept(data, dashboard.kpi_row(reports, data.catalogue, Filters(last_days=90, as_of=today(data))))
            filters = Filters(last_days=365, as_of=today(data), sources=["HSP", "PSC"])
            return kept(data, dashboard.by_source(reports, data.catalogue, filters))


_BATCHED = with_reports() + f""", span as (
    select min(performed_date) as first, max(performed_date) + 1 as past from performed),
  batched as (select j.*, ((performed_date - first) // {DAYS} + 1)::bigint as batch from joined j, span),
  numbered as (select unnest(range(1, ((past - first + {DAYS - 1}) // {DAYS} + 1)::bigint)) as batch, first, past
    from span),
  window_of as (select batch, first + ((batch - 1) * {DAYS})::integer as first,
      least(first + (batch * {DAYS})::integer, past) as past from numbered),
  outcome as (select w.batch, {day_sql('w.first')} as period_start, {day_sql('w.past')} as period_end,
      (select count(*) from performed p join procedure_cat c using (procedure_code)
        where c.active and p.performed_date >= w.first and p.performed_date < w.past) as performed,
      (select count(*) from batched b where b.batch = w.batch) as reports_found,
      (select count(distinct accession_number) from batched b where b.batch = w.batch) as distinct_accessions
    from window_of w)
"""


def _backfill(data: Data, table: str, dry_run: bool = False, **options) -> DataFrame:
    """The whole history, from the first performed day to the last one."""
    first, past = data.performed.agg(F.min("performed_date"), F.date_add(F.max("performed_date"), 1)).first()
    procedures = data.catalogue.procedures
    return run_backfill(data.spark, _sources(data), procedures, _modes(data), table, first, past, DAYS, dry_run, **options)


@query(
    "backfill_outcomes",
    _BATCHED
    + """select batch, period_start, period_end, case when reports_found > 0 then 'loaded' else 'empty' end as status,
           performed, reports_found, nullif(distinct_accessions, 0) as reports_loaded from outcome""",
)
def _(data: Data) -> DataFrame:
    with own_table(data) as table:
        return _backfill(data, table).select(
            "batch", "period_start", "period_end", "status", "performed", "reports_found", "reports_loaded"
        )


@query(
    "backfill_dry_run_summary",
    _BATCHED
    + """select count(*) as batches_ok, 0::bigint as batches_failed, sum(performed)::bigint as performed,
           sum(reports_found)::bigint as reports_found, 0::bigint as reports_loaded from outcome""",
)
def _(data: Data) -> DataFrame:
    return backfill_summary(_backfill(data, "no_table", dry_run=True)).drop("minutes", "mean_seconds")


# A later batch takes the place of an earlier one's report of the same number.
@query(
    "backfilled_reports",
    _BATCHED
    + f"""select {REPORT_COLUMNS} from batched qualify row_number() over (partition by accession_number
           order by batch desc, source, encounter_id, occurrence_no, order_no, procedure_code,
             patient_id, performed_at) = 1""",
)
def _(data: Data) -> DataFrame:
    with own_table(data) as table:
        _backfill(data, table)
        return kept(data, with_digest(data.spark.read.table(table).drop("loaded_at", "run_mode")))


# A first run is ended after its third batch; the second one takes up what is left.
@query(
    "backfill_taken_up_again",
    _BATCHED
    + """select batch, period_start, period_end, case when batch <= 3 then 'skipped'
           when reports_found > 0 then 'loaded' else 'empty' end as status, distinct_accessions as ledger_reports
         from outcome""",
)
def _(data: Data) -> DataFrame:
    with own_table(data) as table, own_table(data) as ledger:
        noted = []

        def ended(line: dict) -> None:
            noted.append(line)
            if len(noted) == 3:
                raise KeyboardInterrupt

        try:
            _backfill(data, table, ledger=ledger, source_version="1", after_batch=ended)
        except KeyboardInterrupt:
            pass
        results = _backfill(data, table, ledger=ledger, source_version="1")
        lines = data.spark.read.table(ledger).select("period_start", F.col("reports_loaded").alias("ledger_reports"))
        found = results.join(lines, "period_start", "left")
        return kept(data, found.select("batch", "period_start", "period_end", "status", "ledger_reports"))


@query(
    "daily_metrics",
    with_reports()
    + """, day as (select * from joined where performed_date = date '1996-05-06')
         select '1996-05-06' as processed_date, '1996-05-06' as period_start, '1996-05-07' as period_end,
           'job_diario' as run_mode, (select count(*) from procedure_cat where active) as procedures_active,
           (select count(*) from performed p join procedure_cat c using (procedure_code)
             where c.active and p.performed_date = date '1996-05-06') as procedures_performed,
           count(distinct accession_number) as reports_loaded, count(distinct accession_number) as total_reports
         from day""",
)
def _(data: Data) -> DataFrame:
    with own_table(data) as table, own_table(data) as metrics:
        run_daily(
            data.spark, _sources(data), data.catalogue.procedures, _modes(data), table, metrics,
            day_to_process="1996-05-06",
        )
        return kept(data, data.spark.read.table(metrics).drop("run_at"))


_CSV = ", ".join(CSV_COLUMNS)


@query("catalogue_file", with_standins("csv_lines") + f"select {_CSV} from csv_lines")
def _(data: Data) -> DataFrame:
    path = f"{Staging(data.spark).root}/catalogue"
    named = [F.col(c).alias(h) for c, h in zip(CSV_COLUMNS, CSV_HEADERS)]
    writer = data.table("csv_lines").select(*named).write.option("sep", ";").option("header", True)
    for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(side, False)
    writer.csv(path)
    return read_catalogue_csv(data.spark, path).drop("line_no")
