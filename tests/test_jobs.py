from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reportlake import schemas
from reportlake.operators.extract import active_codes, extract_reports, one_per_accession
from reportlake.operators.filters import Catalogue, Filters
from reportlake.plans import backfill, daily, dashboard, monitoring, structuring
from reportlake.schemas import RUN_DAILY, RUN_REPROCESS
from reportlake.session import staging
from reportlake.sources import sinks, systems, tables
from reportlake.sources.systems import JdbcSystem, SnapshotSystem, SourceTables


@pytest.fixture
def sources(spark):
    performed, encounters, texts = [], [], []
    for n in range(60):
        source = "HSP" if n % 2 else "PSC"
        performed.append((1000 + n, 1, 2, n % 4, date(2024, 1, 1 + n % 30), str(n * 60), source))
        encounters.append((1000 + n, n % 7, source))
        texts.append((1000 + n, 1, 2, None if n % 10 == 0 else f"EXAME: x {n}\nACHADOS: ok.", source))
    performed += performed[:5]
    return SourceTables(
        spark.createDataFrame(performed, schemas.PERFORMED),
        spark.createDataFrame(encounters, schemas.ENCOUNTERS),
        spark.createDataFrame(texts, schemas.REPORT_TEXTS),
    )


@pytest.fixture
def procedures(spark):
    rows = [(c, f"procedure {c}", 1, *[None] * 7, c != 3, None, None) for c in range(4)]
    return spark.createDataFrame(rows, schemas.PROCEDURES)


@pytest.fixture
def modes(spark):
    return spark.createDataFrame(
        [(RUN_DAILY, True), (RUN_REPROCESS, True), ("off", False)], schemas.RUN_MODES
    )


def contents(df):
    return sorted(map(tuple, df.select("accession_number", "report_text", "year_month", "performed_at").collect()))


def test_daily_run(spark, database, sources, procedures, modes):
    table, metrics = f"{database}.reports", f"{database}.metrics"
    for _ in range(2):
        outcome = daily.run_daily(
            spark, sources, procedures, modes, table, metrics,
            mode=RUN_REPROCESS, day_to_process="2024-01-10", back_days=9, compact=True,
        )
    assert outcome.status == daily.LOADED
    assert outcome.metrics["procedures_active"] == 3
    assert outcome.metrics["total_reports"] == outcome.metrics["reports_loaded"]
    recorded = spark.read.table(metrics)
    assert recorded.count() == 2 and recorded.schema.fieldNames() == schemas.JOB_METRICS.fieldNames()
    assert recorded.first().processed_date == date(2024, 1, 10)
    assert monitoring.duplicate_keys(spark.read.table(table)).isEmpty()


def test_a_small_window_is_sent_to_the_texts(spark, sources, procedures, plan_of):
    with staging(spark) as area:
        codes = active_codes(procedures)
        window = (date(2024, 1, 3), date(2024, 1, 5))
        performed, rows = daily.window_rows(area, sources, codes, window)
        plan = plan_of(rows)
        assert "BroadcastHashJoin" in plan and "BuildLeft" in plan
        assert "hashpartitioning" not in plan
        assert {r.procedure_code for r in performed.collect()} <= {0, 1, 2}


def test_one_key_on_a_third_of_the_rows(spark):
    """Hot procedure, hot accession number and hot patient at once; nothing is lost."""
    n = 3000
    ids = spark.range(n)
    hot = F.col("id") % 3 == 0
    performed = ids.select(
        F.when(hot, 1).otherwise(F.col("id") + 2).alias("encounter_id"),
        F.lit(1).cast("bigint").alias("occurrence_no"),
        F.lit(2).cast("bigint").alias("order_no"),
        F.when(hot, 0).otherwise(F.col("id") % 3).cast("bigint").alias("procedure_code"),
        F.lit("2024-01-01").cast("date").alias("performed_date"),
        F.col("id").cast("string").alias("performed_seconds"),
        F.lit("HSP").alias("source"),
    )
    keys = performed.select("encounter_id", "occurrence_no", "order_no", "source").distinct()
    encounters = keys.select("encounter_id", F.lit(7).cast("bigint").alias("patient_id"), "source")
    texts = keys.withColumn("report_text", F.lit("text"))
    rows = extract_reports(performed, encounters, texts, None)
    assert rows.count() == n
    kept = one_per_accession(rows)
    assert kept.count() == keys.count() == 1 + n - n // 3
    assert monitoring.duplicate_keys(rows).collect()[0].rows == n // 3
    top = monitoring.top_codes(rows, 1).first()
    assert (top.procedure_code, top.rows) == (0, n // 3)


def test_daily_run_ends_early(spark, database, sources, procedures, modes):
    def run(procs, **options):
        return daily.run_daily(spark, sources, procs, modes, f"{database}.reports", **options).status

    assert run(procedures.filter("false"), day_to_process="2024-01-05") == daily.NO_PROCEDURES
    assert run(procedures, day_to_process="2030-01-05") == daily.NOTHING_PERFORMED
    blank = SourceTables(sources.performed, sources.encounters, sources.reports.withColumn("report_text", F.lit(" ")))
    assert (
        daily.run_daily(spark, blank, procedures, modes, f"{database}.reports", day_to_process="2024-01-05").status
        == daily.NO_REPORTS
    )
    assert not tables.table_exists(spark, f"{database}.reports")
    for mode in ("off", "unheard of"):
        with pytest.raises(ValueError):
            run(procedures, mode=mode)


@pytest.mark.parametrize("days", [7, 30])
def test_backfill_in_batches_is_one_load(spark, database, sources, procedures, modes, days):
    one, many = f"{database}.one", f"{database}.many"
    backfill.run_backfill(spark, sources, procedures, modes, one, "2024-01-01", "2024-02-01", 31)
    batches = backfill.run_backfill(spark, sources, procedures, modes, many, "2024-01-01", "2024-02-01", days)
    assert contents(spark.read.table(one)) == contents(spark.read.table(many))
    summary = monitoring.backfill_summary(batches).first()
    assert summary.batches_failed == 0
    assert summary.reports_loaded == spark.read.table(many).count()
    assert summary.reports_found > summary.reports_loaded
    assert summary.mean_seconds > 0


def test_a_backfill_reads_the_texts_once(spark, database, sources, procedures, modes):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = sources.reports.mapInArrow(seen, sources.reports.schema)
    tables_ = SourceTables(sources.performed, sources.encounters, counted)
    args = (spark, tables_, procedures, modes, f"{database}.reports", "2024-01-01", "2024-02-01", 7)
    backfill.run_backfill(*args, dry_run=True)
    assert read.value == sources.reports.count()
    backfill.run_backfill(*args, compact=True)
    assert read.value == 2 * sources.reports.count()


def test_a_dry_run_moves_no_text_and_jobs_hash_above_the_join(spark, sources, procedures, plan_of):
    with staging(spark) as area:
        codes = active_codes(procedures)
        windows = dict(enumerate(backfill.batch_windows("2024-01-01", "2024-02-01", 7), 1))
        assert backfill._Part(area, sources, codes, windows, date(2024, 1, 1), 7).counts()
    with staging(spark) as area:
        _, rows = daily.window_rows(area, sources, codes, (date(2024, 1, 3), date(2024, 1, 5)))
        lines = plan_of(rows).splitlines()
        join = next(k for k, line in enumerate(lines) if "BroadcastHashJoin" in line)
        assert not any("xxhash64" in line for line in lines[join + 1 :])


def test_dry_run_counts_and_writes_nothing(spark, database, sources, procedures, modes):
    table = f"{database}.reports"
    batches = backfill.run_backfill(
        spark, sources, procedures, modes, table, "2024-01-01", "2024-03-01", 30, dry_run=True
    ).orderBy("batch").collect()
    assert [b.status for b in batches] == [backfill.COUNTED, backfill.EMPTY]
    assert batches[0].distinct_procedures == 3 and batches[0].reports_found > batches[0].distinct_accessions
    assert not tables.table_exists(spark, table)


def test_a_failing_batch_does_not_stop_the_others(spark, database, sources, procedures, modes):
    bad = F.when(F.col("encounter_id") == 1001, F.raise_error(F.lit("broken " + "x" * 900))).otherwise(F.col("report_text"))
    broken = SourceTables(sources.performed, sources.encounters, sources.reports.withColumn("report_text", bad))
    table = f"{database}.reports"
    # The bad text belongs to the second of January; later windows never read it.
    only = SourceTables(broken.performed, broken.encounters, broken.reports.filter("encounter_id in (1001, 1020, 1022)"))
    rows = backfill.run_backfill(spark, only, procedures, modes, table, "2024-01-01", "2024-01-29", 14).orderBy("batch").collect()
    assert rows[0].status == backfill.FAILED and "x" * 900 in rows[0].error
    summary = monitoring.backfill_summary(backfill.batch_results(spark, [r.asDict() for r in rows])).first()
    assert summary.batches_failed >= 1


def test_batches_are_read_by_halves_where_the_whole_fails(spark, database, sources, procedures, modes):
    read = []
    table = f"{database}.reports"
    # a reading fails when it meets the second of January, whatever else it reads
    performed = sources.performed.withColumn(
        "performed_seconds", F.when(F.col("performed_date") == "2024-01-02", F.raise_error(F.lit("broken"))).otherwise(F.col("performed_seconds"))
    )
    broken = SourceTables(performed, sources.encounters, sources.reports)
    rows = backfill.run_backfill(
        spark, broken, procedures, modes, table, "2024-01-01", "2024-01-29", 7, after_batch=read.append
    ).orderBy("batch").collect()
    assert [r.status for r in rows] == [backfill.FAILED, *[backfill.LOADED] * 3]
    assert "broken" in rows[0].error and all("broken" in r.scan_error for r in rows)
    assert len(read) == 3
    whole = f"{database}.whole"
    fine = SourceTables(sources.performed.filter("performed_date >= '2024-01-08'"), sources.encounters, sources.reports)
    backfill.run_backfill(spark, fine, procedures, modes, whole, "2024-01-08", "2024-01-29", 7)
    assert contents(spark.read.table(table)) == contents(spark.read.table(whole))


def test_a_backfill_goes_on_behind_its_ledger(spark, database, sources, procedures, modes):
    table, ledger = f"{database}.reports", f"{database}.ledger"
    args = (spark, sources, procedures, modes, table, "2024-01-01", "2024-02-01", 7)

    def killed(outcome):
        if outcome["batch"] == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        backfill.run_backfill(*args, ledger=ledger, source_version="v1", after_batch=killed)
    assert spark.read.table(ledger).count() == 2
    again = backfill.run_backfill(*args, ledger=ledger, source_version="v1")
    assert [r.status for r in again.orderBy("batch").collect()] == [*["skipped"] * 2, *["loaded"] * 3]
    summary = monitoring.backfill_summary(again).first()
    assert (summary.batches_ok, summary.batches_failed) == (5, 0)
    whole = f"{database}.whole"
    backfill.run_backfill(spark, sources, procedures, modes, whole, "2024-01-01", "2024-02-01", 31)
    assert contents(spark.read.table(table)) == contents(spark.read.table(whole))
    other = backfill.run_backfill(*args, ledger=ledger, source_version="v2")
    assert {r.status for r in other.collect()} == {"loaded"}
    assert spark.read.table(ledger).count() == 10


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_texts_are_shuffled_once(spark, sources, procedures, plan_of, threshold):
    """The plan that loads a window exchanges report texts once, whichever side is small."""
    expected = None
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    doubled = SourceTables(sources.performed, sources.encounters, sources.reports.union(sources.reports))
    try:
        with staging(spark) as area:
            _, rows = daily.window_batch(area, doubled, active_codes(procedures), (date(2024, 1, 1), date(2024, 2, 1)))
            plan = plan_of(rows, brief=False)
            blocks = [b for b in plan.split("\n\n") if b.lstrip().startswith("(") and ") Exchange" in b.splitlines()[0]]
            assert sum("report_text" in b for b in blocks) == 1
            expected = sorted(map(tuple, rows.select("accession_number", "report_text", "source", "procedure_code").collect()))
            whole = one_per_accession(extract_reports(sources.performed, sources.encounters, sources.reports, active_codes(procedures)))
            assert expected == sorted(map(tuple, whole.select("accession_number", "report_text", "source", "procedure_code").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    "start, end, days, expected",
    [("2024-01-01", "2024-01-15", 7, 2), ("2024-01-01", "2024-01-16", 7, 3), ("2024-01-01", "2024-01-02", 30, 1)],
)
def test_batch_windows(start, end, days, expected):
    windows = backfill.batch_windows(start, end, days)
    assert len(windows) == expected
    assert windows[0][0].isoformat() == start and windows[-1][1].isoformat() == end
    assert all(a[1] == b[0] for a, b in zip(windows, windows[1:]))


@pytest.mark.parametrize("start, end", [("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-01")])
def test_batch_windows_need_a_period(start, end):
    with pytest.raises(ValueError):
        backfill.batch_windows(start, end, 7)


def test_snapshot_reader_tags_and_renames(spark, tmp_path):
    raw = {
        "performed": ("CD_ATENDIMENTO bigint, CD_OCORRENCIA bigint, CD_ORDEM bigint, CD_PROCEDIMENTO bigint, DT_PROCEDIMENTO_REALIZADO date, HR_PROCEDIMENTO_REALIZADO bigint", (1, 2, 3, 4, date(2024, 1, 1), 60)),
        "encounters": ("CD_ATENDIMENTO bigint, CD_PACIENTE bigint", (1, 9)),
        "reports": ("CD_ATENDIMENTO bigint, CD_OCORRENCIA bigint, CD_ORDEM bigint, DS_LAUDO_MEDICO string", (1, 2, 3, "text")),
    }
    setup = {}
    for tag in schemas.SOURCES:
        for name, (ddl, row) in raw.items():
            spark.createDataFrame([row], ddl).write.parquet(str(tmp_path / tag / name))
        setup[tag] = SnapshotSystem(*[str(tmp_path / tag / n) for n in raw])
    read = systems.read_systems(spark, setup)
    assert sorted(r.source for r in read.performed.collect()) == ["HSP", "PSC"]
    assert read.performed.schema.fieldNames() == schemas.PERFORMED.fieldNames()
    assert read.performed.first().performed_seconds == "60"
    assert read.encounters.count() == 2 and read.reports.first().report_text == "text"


def test_sources_are_read_by_the_keys_of_a_window(spark, tmp_path, plan_of, procedures, modes, database):
    days = [date(2024, 1, 1 + n % 20) for n in range(200)]
    raw = {
        "performed": ("CD_ATENDIMENTO bigint, CD_OCORRENCIA bigint, CD_ORDEM bigint, CD_PROCEDIMENTO bigint, DT_PROCEDIMENTO_REALIZADO date, HR_PROCEDIMENTO_REALIZADO bigint", [(1000 * d.day + n, 2, 3, 1, d, 60) for n, d in enumerate(days)]),
        "encounters": ("CD_ATENDIMENTO bigint, CD_PACIENTE bigint", [(1000 * d.day + n, 9) for n, d in enumerate(days)]),
        "reports": ("CD_ATENDIMENTO bigint, CD_OCORRENCIA bigint, CD_ORDEM bigint, DS_LAUDO_MEDICO string", [(1000 * d.day + n, 2, 3, f"text {n}") for n, d in enumerate(days)]),
    }
    for name, (ddl, rows) in raw.items():
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / name))
    read = systems.read_systems(spark, {"HSP": SnapshotSystem(*[str(tmp_path / n) for n in raw])})
    performed = read.performed.filter("performed_date in ('2024-01-03', '2024-01-19')")
    narrowed = read.narrowed(performed)
    assert 20 <= narrowed.reports.count() <= 30 and narrowed.encounters.count() == narrowed.reports.count()
    plan = plan_of(narrowed.reports, brief=False)
    assert "PushedFilters: [Or(" in plan.replace("And(", "Or(") and "GreaterThanOrEqual(CD_ATENDIMENTO" in plan
    whole = SourceTables(read.performed, read.encounters, read.reports)
    for name, sources in (("a", read), ("b", whole)):
        daily.run_daily(spark, sources, procedures, modes, f"{database}.{name}", mode=RUN_REPROCESS, day_to_process="2024-01-05", back_days=2)
    assert contents(spark.read.table(f"{database}.a")) == contents(spark.read.table(f"{database}.b")) != []


def test_key_ranges_hold_all_keys_and_leave_gaps(spark):
    keys = [*range(5), *range(10_000, 10_500), 999_999]
    rows = spark.createDataFrame([(k,) for k in keys] + [(None,)], "encounter_id bigint")
    ranges = systems.key_ranges(rows, parts=8)
    assert len(ranges) <= 8 and all(any(a <= k <= b for a, b in ranges) for k in keys)
    assert sum(b - a for a, b in ranges[:-1]) < 10_600
    assert systems.key_ranges(rows.limit(0)) == [] and systems.range_predicates("K", []) == ["1 = 0"]
    assert systems.range_predicates("CD_ATENDIMENTO", [(1, 5), (9, 9)]) == ["CD_ATENDIMENTO BETWEEN 1 AND 5", "CD_ATENDIMENTO BETWEEN 9 AND 9"]


def test_a_period_prunes_months_by_default(spark, database, plan_of):
    table = f"{database}.reports"
    rows = [
        (n, 1, 2, f"k{n:02}", 1, 5, "t", datetime(2024, 1 + n % 6, 3), "HSP", datetime(2024, 7, 1), RUN_DAILY, f"2024-{1 + n % 6:02}")
        for n in range(60)
    ]
    sinks.create_reports(spark.createDataFrame(rows, schemas.REPORTS), table)
    filters = Filters(last_days=30, as_of="2024-06-15")
    catalogue = Catalogue(
        spark.createDataFrame([(1, "CT", True, None, None)], schemas.MODALITIES),
        spark.createDataFrame([], schemas.DESCRIPTIONS),
        spark.createDataFrame([(1, "p", 1, *[None] * 7, True, None, None)], schemas.PROCEDURES),
    )
    builders = [getattr(dashboard, n) for n in ("kpi_row", "daily_volume", "by_source", "top_modalities", "top_procedures", "by_weekday", "by_hour", "top_descriptions", "modality_detail")]
    for build in builders:
        plan = plan_of(build(sinks.read_reports(spark, table), catalogue, filters), brief=False)
        assert "(year_month" in plan and ">= 2024-05)" in plan.split("PartitionFilters: [", 1)[1], build
    before = dashboard.kpi_row(sinks.read_reports(spark, table), catalogue, filters).first()
    assert before.reports == 10
    # a report whose seconds pushed it two months on is found, and the table says so
    late = spark.createDataFrame([(99, 1, 2, "late", 1, 5, "t", datetime(2024, 6, 2), "HSP", datetime(2024, 7, 1), RUN_DAILY, "2024-04")], schemas.REPORTS)
    sinks.upsert_reports(spark, late, table, RUN_DAILY)
    reports = sinks.read_reports(spark, table)
    assert dashboard.kpi_row(reports, catalogue, filters).first().reports == 11
    assert reports.schema["year_month"].metadata == {schemas.MONTH_SLACK: 2}
    assert ">= 2024-03)" in plan_of(dashboard.kpi_row(reports, catalogue, filters), brief=False)


def test_jdbc_reader_splits_by_encounter():
    system = JdbcSystem("jdbc:x", "P", "E", "R", {"user": "u"}, upper_bound=800)
    options = system.options("P")
    assert options["numPartitions"] == "8" and options["dbtable"] == "P" and options["user"] == "u"
    assert options["partitionColumn"] == "CD_ATENDIMENTO" and options["upperBound"] == "800"


def test_structuring_job_appends_and_upserts(spark, database, sources, procedures, modes):
    reports, output = f"{database}.reports", f"{database}.structured"
    daily.run_daily(spark, sources, procedures, modes, reports, mode=RUN_REPROCESS, day_to_process="2024-01-30", back_days=30)
    structuring.run_structuring(spark, reports, output, "2024-01-01", "2024-02-01", limit=5)
    assert spark.read.table(output).count() == 5
    structuring.run_structuring(spark, reports, output, limit=5)
    assert spark.read.table(output).count() == 10
    structuring.run_structuring(spark, reports, f"{output}_once", limit=0)
    everything = spark.read.table(reports).count()
    structuring.run_structuring(spark, reports, f"{output}_once", limit=5, upsert=True)
    once = spark.read.table(f"{output}_once")
    assert once.count() == everything == once.select("accession_number").distinct().count()
    row = once.first()
    assert row.model == "rules" and row.temperature == 0.0
    assert row.formatted_text.startswith("EXAME: x") and "FINDINGS:" in row.formatted_text
    assert "# Your report" in row.raw_prompt


def test_structured_months_that_do_not_change_keep_their_files(spark, database):
    reports, output = f"{database}.reports", f"{database}.structured"
    rows = [
        (n, 1, 2, f"k{n:02}", 1, 5, f"EXAME: x {n}\nACHADOS: ok.", datetime(2024, 1 + n % 4, 3), "HSP", datetime(2024, 5, 1), RUN_DAILY, f"2024-{1 + n % 4:02}")
        for n in range(40)
    ]
    sinks.create_reports(spark.createDataFrame(rows, schemas.REPORTS), reports)
    structuring.run_structuring(spark, reports, output, upsert=True)
    files = lambda: {f for f in spark.read.table(output).inputFiles()}
    before = files()
    structuring.run_structuring(spark, reports, output, "2024-02-01", "2024-03-01", upsert=True, model="second")
    spark.catalog.refreshTable(output)
    changed = before ^ files()
    assert changed and all("year_month=2024-02" in f for f in changed)
    models = spark.read.table(output).groupBy("year_month", "model").count().collect()
    assert sorted(map(tuple, models)) == [("2024-01", "rules", 10), ("2024-02", "second", 10), ("2024-03", "rules", 10), ("2024-04", "rules", 10)]
    # a report that moved takes its result with it
    moved = spark.createDataFrame([(*rows[0][:6], "EXAME: new\nACHADOS: ok.", datetime(2024, 4, 9), *rows[0][8:11], "2024-04")], schemas.REPORTS)
    sinks.upsert_reports(spark, moved, reports, RUN_REPROCESS)
    structuring.run_structuring(spark, reports, output, "2024-04-01", "2024-05-01", upsert=True, model="third")
    found = {r.accession_number: r for r in spark.read.table(output).collect()}
    assert len(found) == 40 == spark.read.table(output).count()
    assert found["k00"].year_month == "2024-04" and found["k00"].formatted_text.startswith("EXAME: new")
    # rows that were appended are found by the next upsert
    structuring.run_structuring(spark, reports, output, "2024-03-01", "2024-04-01", model="appended")
    structuring.run_structuring(spark, reports, output, "2024-03-01", "2024-04-01", model="last", upsert=True)
    again = spark.read.table(output).filter("year_month = '2024-03'")
    assert {r.model for r in again.collect()} == {"last"} and again.count() == 20


def test_an_output_without_months_is_kept_as_it_is(spark, database, sources, procedures, modes):
    reports, output = f"{database}.reports", f"{database}.structured"
    daily.run_daily(spark, sources, procedures, modes, reports, mode=RUN_REPROCESS, day_to_process="2024-01-30", back_days=30)
    spark.createDataFrame([], schemas.STRUCTURED_REPORTS).write.saveAsTable(output)
    structuring.run_structuring(spark, reports, output, limit=5)
    structuring.run_structuring(spark, reports, output, limit=7, upsert=True)
    found = spark.read.table(output)
    assert found.columns == schemas.STRUCTURED_REPORTS.fieldNames() and found.count() == 7


def test_select_reports_refuses_a_bad_date(spark, sources):
    with pytest.raises(ValueError):
        structuring.select_reports(sources.reports, "01-02-2024")


def test_catalogue_tables(spark, database):
    assert not tables.catalogue_exists(spark, database)
    for _ in range(2):
        tables.create_catalogue(spark, database)
    assert tables.catalogue_exists(spark, database)
    assert tables.conform(spark.read.table(f"{database}.procedures"), schemas.PROCEDURES).isEmpty()
    tables.drop_catalogue(spark, database)
    assert not tables.catalogue_exists(spark, database)


def test_parameterised_query(spark):
    got = tables.run_query(spark, "select :name || '!' as x", name="d'Ávila").first()
    assert got.x == "d'Ávila!"
    with pytest.raises(Exception):
        tables.run_query(spark, "select nothing from nowhere").collect()


def test_lower_case_columns(spark):
    assert tables.lower_case_columns(spark.createDataFrame([(1, 2)], "A int, bC int")).columns == ["a", "bc"]
