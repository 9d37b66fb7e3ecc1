import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.extraction import merge_sides
from checks.standins import Data
from reportlake import schemas
from reportlake.operators import extract, upsert
from reportlake.schemas import RUN_DAILY, RUN_REPROCESS
from reportlake.session import Staging
from reportlake.sources import sinks, tables
from reportlake.plans.monitoring import duplicate_keys

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def report(key, month, text, at=OLD, mode=RUN_DAILY, code=1):
    return (1, 2, 3, key, code, 5, text, datetime(2024, int(month[5:]), 2), "HSP", at, mode, month)


@pytest.fixture
def sides(spark):
    target = [report("a", "2024-01", "old a"), report("b", "2024-02", "old b"), report("c", "2024-03", "old c")]
    source = [
        report("b", "2024-02", None, NEW, RUN_REPROCESS, code=9),
        report("c", "2024-04", "new c", NEW, RUN_REPROCESS, code=9),
        report("d", "2024-05", "new d", NEW, RUN_REPROCESS, code=9),
    ]
    return (
        spark.createDataFrame(target, schemas.REPORTS),
        spark.createDataFrame(source, schemas.REPORTS),
    )


def by_key(df):
    return {r.accession_number: (r.report_text, r.year_month, r.run_mode, r.loaded_at, r.procedure_code) for r in df.collect()}


DAILY = {
    "a": ("old a", "2024-01", RUN_DAILY, OLD, 1),
    "b": (None, "2024-02", RUN_DAILY, NEW, 1),
    "c": ("new c", "2024-03", RUN_DAILY, NEW, 1),
    "d": ("new d", "2024-05", RUN_REPROCESS, NEW, 9),
}
ALL = {
    "a": ("old a", "2024-01", RUN_DAILY, OLD, 1),
    "b": (None, "2024-02", RUN_REPROCESS, NEW, 9),
    "c": ("new c", "2024-04", RUN_REPROCESS, NEW, 9),
    "d": ("new d", "2024-05", RUN_REPROCESS, NEW, 9),
}


@pytest.mark.parametrize("small", [False, True])
def test_rules(sides, small):
    assert by_key(upsert.merge_daily(*sides, small_source=small)) == DAILY
    assert by_key(upsert.merge_all(*sides, small_source=small)) == ALL


@pytest.mark.parametrize("small", [False, True])
def test_columns_made_of_the_text_go_with_it(sides, small):
    old, new = (side.withColumn("size", F.length("report_text")) for side in sides)
    merged = upsert.merge_daily(old, new, small_source=small, of_text=["size"])
    assert by_key(merged) == DAILY
    assert merged.filter(~F.col("size").eqNullSafe(F.length("report_text"))).isEmpty()


@pytest.mark.parametrize("small", [False, True])
def test_merging_twice_changes_nothing(sides, small):
    target, source = sides
    for rule in (upsert.merge_daily, upsert.merge_all):
        once = rule(target, source, small_source=small)
        assert by_key(rule(once, source, small_source=small)) == by_key(once)


@pytest.mark.parametrize("mode, expected", [(RUN_DAILY, DAILY), (RUN_REPROCESS, ALL)])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_table_upsert(spark, database, sides, mode, expected, threshold):
    table = f"{database}.reports"
    target, source = sides
    sinks.upsert_reports(spark, target, table, mode)
    assert spark.read.table(table).count() == 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for _ in range(2):
            sinks.upsert_reports(spark, source, table, mode)
            assert by_key(spark.read.table(table)) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert duplicate_keys(spark.read.table(table)).isEmpty()
    months = [r[0] for r in tables.list_partitions(spark.read.table(table)).collect()]
    assert months == sorted({row[1] for row in expected.values()})


def test_small_batch_leaves_the_table_where_it_is(spark, sides, plan_of, tmp_path):
    target, source = sides
    for name, df in (("target", target), ("source", source)):
        df.write.parquet(str(tmp_path / name))
    read = [spark.read.schema(schemas.REPORTS).parquet(str(tmp_path / n)) for n in ("target", "source")]
    plan = plan_of(upsert.merge_daily(*read, small_source=True))
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_compaction_keeps_the_rows_in_fewer_files(spark, database):
    table = f"{database}.reports"
    rows = [report(f"k{i}", f"2024-0{1 + i % 2}", f"text {i}", code=i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, schemas.REPORTS)
    df.repartition(6).write.partitionBy("year_month").saveAsTable(table)
    before = by_key(spark.read.table(table))
    files = len(spark.read.table(table).inputFiles())
    sinks.compact_reports(spark, table, ["2024-01"])
    sinks.compact_reports(spark, table)
    spark.catalog.refreshTable(table)
    after = spark.read.table(table)
    assert by_key(after) == before
    assert len(after.inputFiles()) < files
    codes = [r.procedure_code for r in after.filter("year_month = '2024-01'").collect()]
    assert codes == sorted(codes)


def index_of(spark, table):
    return {(r.accession_number, r.year_month) for r in spark.read.table(sinks.keys_table(table)).collect()}


@pytest.mark.parametrize("mode", [RUN_DAILY, RUN_REPROCESS])
def test_the_keys_cover_the_table_after_every_merge(spark, database, sides, mode):
    table = f"{database}.reports"
    for batch in (*sides, sides[0]):
        sinks.upsert_reports(spark, batch, table, mode)
        held = {(r.accession_number, r.year_month) for r in spark.read.table(table).collect()}
        assert held <= index_of(spark, table)
    assert spark.read.table(sinks.keys_table(table)).distinct().count() == spark.read.table(sinks.keys_table(table)).count()
    sinks.compact_reports(spark, table)
    assert index_of(spark, table) == {(r.accession_number, r.year_month) for r in spark.read.table(table).collect()}


def test_a_batch_reads_the_key_folders_it_hits_and_no_key_of_the_table(spark, database, monkeypatch):
    table = f"{database}.reports"
    rows = [report(f"k{i:04}", f"2024-0{1 + i % 9}", "t") for i in range(2000)]
    sinks.create_reports(spark.createDataFrame(rows, schemas.REPORTS), table)
    batch = spark.createDataFrame([report("k0003", "2024-01", "new"), report("other", "2024-02", "new")], schemas.REPORTS)
    hit = sinks.keys_hit(spark, table, batch)
    everything = spark.read.table(sinks.keys_table(table))
    assert len(hit.inputFiles()) <= 2 < 32 < len(everything.inputFiles())
    assert hit.count() < everything.count() / 8
    months = []
    original = sinks._files_of
    monkeypatch.setattr(sinks, "_files_of", lambda s, t, m: months.append(m) or original(s, t, m))
    monkeypatch.setattr(sinks, "build_keys", None)
    sinks.upsert_reports(spark, batch, table, RUN_DAILY)
    assert months[0] == ["2024-01", "2024-02", "2024-04"]
    found = by_key(spark.read.table(table))
    assert len(found) == 2001 and found["k0003"][:2] == ("new", "2024-04")


def test_keys_are_built_anew_for_a_table_that_came_from_elsewhere(spark, database, sides):
    target, source = sides
    table = f"{database}.reports"
    sinks.upsert_reports(spark, source, table, RUN_DAILY)
    spark.sql(f"DROP TABLE {table}")
    target.write.partitionBy("year_month").saveAsTable(table)
    sinks.upsert_reports(spark, source, table, RUN_DAILY)
    assert by_key(spark.read.table(table)) == DAILY
    spark.createDataFrame([report("z", "2024-01", "z")], schemas.REPORTS).write.insertInto(table)
    sinks.forget_keys(spark, table)
    sinks.upsert_reports(spark, spark.createDataFrame([report("z", "2024-07", "z2", NEW)], schemas.REPORTS), table, RUN_DAILY)
    assert by_key(spark.read.table(table))["z"][:2] == ("z2", "2024-01")
    assert spark.read.table(table).count() == 5


def test_a_merge_that_fails_at_the_swap_can_be_repeated(spark, database, sides, monkeypatch):
    target, source = sides
    table = f"{database}.reports"
    sinks.upsert_reports(spark, target, table, RUN_REPROCESS)
    swap = sinks._replace_months

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "_replace_months", broken)
    with pytest.raises(RuntimeError, match="lost"):
        sinks.upsert_reports(spark, source, table, RUN_REPROCESS)
    monkeypatch.setattr(sinks, "_replace_months", swap)
    sinks.upsert_reports(spark, source, table, RUN_REPROCESS)
    assert by_key(spark.read.table(table)) == ALL


def spans(path, column):
    """Least and greatest value of a column in each row group below a folder."""
    import pyarrow.parquet as pq

    found = []
    for file in sorted(path.rglob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            place = next(k for k in range(group.num_columns) if group.column(k).path_in_schema == column)
            stats = group.column(place).statistics
            found.append((stats.min, stats.max))
    return found


def test_the_curve_narrows_every_column(spark, database):
    import random
    from pathlib import Path

    rng = random.Random(9)
    table = f"{database}.reports"
    rows = []
    for _ in range(6000):
        key, code, minute = f"{rng.randrange(10**7):07}", rng.randrange(500), rng.randrange(40_000)
        at = datetime.fromtimestamp(1704067200 + 60 * minute)
        rows.append((1, 2, 3, key, code, 5, "t", at, "HSP", OLD, RUN_DAILY, "2024-01"))
    rows.append((1, 2, 3, "none", None, 5, None, None, "HSP", OLD, RUN_DAILY, "2024-02"))
    columns = ("accession_number", "procedure_code", "performed_at")
    df = spark.createDataFrame(rows, schemas.REPORTS)
    sinks.create_reports(df, table)
    sinks.compact_reports(spark, table, cluster_by=columns, files=64)
    assert sorted(map(repr, spark.read.table(table).collect())) == sorted(map(repr, df.select(*spark.read.table(table).columns).collect()))
    where = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first().data_type
    month = Path(where.removeprefix("file:")) / "year_month=2024-01"
    for column in columns:
        groups = spans(month, column)
        values = sorted({r[3 if column == columns[0] else 4 if column == columns[1] else 7] for r in rows if r[7]})
        some = values[:: len(values) // 20]
        zone = groups[0][0].tzinfo if column == "performed_at" else None
        probes = [v.astimezone(zone) if zone else v for v in some]
        read = sum(a <= v <= b for v in probes for a, b in groups) / len(probes) / len(groups)
        assert len(groups) >= 48 and read < 0.45, (column, read)


def test_rename_columns(spark, database):
    table = f"{database}.reports"
    df = spark.createDataFrame([report("a", "2024-01", "x")], schemas.REPORTS)
    old = df.withColumnsRenamed({"performed_at": "dt_performed", "loaded_at": "dt_loaded"})
    old.write.partitionBy("year_month").saveAsTable(table)
    sinks.rename_table_columns(spark, table, {"dt_performed": "performed_at", "dt_loaded": "loaded_at"})
    assert set(spark.read.table(table).columns) == set(schemas.REPORTS.fieldNames())
    assert tables.list_columns(spark, table)[-1] == ("year_month", "string", True)
    with pytest.raises(ValueError):
        tables.rename_columns(df, {"nope": "x"})


def test_append_creates_then_appends(spark, database):
    table = f"{database}.records"
    row = spark.createDataFrame([(1,)], "n int")
    assert not tables.table_exists(spark, table)
    for expected in (1, 2):
        sinks.append_rows(row, table)
        assert spark.read.table(table).count() == expected


def test_staging_is_removed_also_after_a_failure(spark):
    from reportlake.session import staging

    with pytest.raises(RuntimeError):
        with staging(spark) as area:
            kept = area.write(spark.range(5), "x")
            assert kept.count() == 5 and area.size_in_bytes("x") > 0
            raise RuntimeError
    path = area._path()
    assert not path.getFileSystem(area._conf()).exists(path)


def test_a_failed_replacement_leaves_the_old_table(spark, database):
    table = f"{database}.small"
    spark.range(3).write.saveAsTable(table)
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    with pytest.raises(RuntimeError, match="not replaced"):
        sinks.replace_table(spark, broken, table)
    assert spark.read.table(table).count() == 3
    sinks.replace_table(spark, spark.read.table(table).filter("id > 0"), table)
    assert sorted(r.id for r in spark.read.table(table).collect()) == [1, 2]
    assert [t.name for t in spark.catalog.listTables(database) if "__old" in t.name] == []


def test_a_merge_notices_another_writer(spark, database, sides, monkeypatch):
    table = f"{database}.reports"
    target, source = sides
    sinks.upsert_reports(spark, target, table, RUN_DAILY)
    rule = sinks.merge_daily

    def meanwhile(*args, **options):
        spark.read.table(table).limit(1).write.mode("append").insertInto(table)
        return rule(*args, **options)

    monkeypatch.setattr(sinks, "merge_daily", meanwhile)
    with pytest.raises(sinks.ChangedMeanwhile):
        sinks.upsert_reports(spark, source, table, RUN_DAILY)
    assert spark.read.table(table).count() == 4


def test_loaded_texts_are_moved_once_before_the_table_is_written(spark, plan_of):
    for rows in (Data(spark, "/root/testdata/sf0.001").with_texts(), *merge_sides(Data(spark, "/root/testdata/sf0.001"))):
        moved = re.findall(r"\(\d+\) Exchange\s*\n(?:Input|Output)[^\n]*", plan_of(rows, brief=False))
        assert sum("report_text" in line for line in moved) <= 1
        assert "report_text" in rows.columns


def test_of_texts_under_one_key_the_chosen_one_is_fetched(spark):
    performed = spark.createDataFrame(
        [(1, 1, 5, 9, datetime(2024, 1, 2).date(), "0", "HSP")] * 2 + [(11, 1, 5, 9, datetime(2024, 1, 2).date(), "0", "HSP")],
        schemas.PERFORMED,
    )
    encounters = spark.createDataFrame([(1, 7, "HSP"), (11, 7, "HSP")], "encounter_id long, patient_id long, source string")
    reports = spark.createDataFrame(
        [(1, 1, 5, "HSP", text) for text in ("a", "b", "a", " ")] + [(11, 1, 5, "HSP", "c")],
        "encounter_id long, occurrence_no long, order_no long, source string, report_text string",
    )
    whole = extract.one_per_accession(extract.extract_reports(performed, encounters, reports, None))
    keys = extract.extract_reports(performed, encounters, reports, None, of_text={extract.TEXT_HASH: F.xxhash64("report_text")})
    chosen = extract.one_per_accession(keys, keep_hash=True).drop("report_text")
    fetched = extract.fetch_texts(chosen, reports).select(whole.columns)
    assert sorted(map(tuple, fetched.collect())) == sorted(map(tuple, whole.collect()))
    assert fetched.count() == 2


def test_files_with_texts_are_packed_closely(spark, database, sides):
    sinks.create_reports(sides[0], "testing.packed")
    assert all(".zstd." in name for name in spark.read.table("testing.packed").inputFiles())
    sinks.upsert_reports(spark, sides[1], "testing.packed", RUN_REPROCESS)
    sinks.compact_reports(spark, "testing.packed")
    assert all(".zstd." in name for name in spark.read.table("testing.packed").inputFiles())


def names_of(df):
    return sorted(file.rpartition("/")[2] for file in df.inputFiles())


@pytest.mark.parametrize("elsewhere", [False, True])
def test_rows_are_written_once_by_a_merge_and_a_compaction(spark, database, sides, monkeypatch, elsewhere):
    table = f"{database}.reports"
    target, source = sides
    sinks.upsert_reports(spark, target, table, RUN_REPROCESS)
    staged, swap = [], sinks._overwrite_months

    def seen(spark, area, name, table):
        staged.append(names_of(area.read_back(name)))
        swap(spark, area, name, table)

    monkeypatch.setattr(sinks, "_overwrite_months", seen)
    if elsewhere:  # a table in another store gets the staged rows by an insert
        monkeypatch.setattr(Staging, "swap", lambda *_: False)
    sinks.upsert_reports(spark, source, table, RUN_REPROCESS)
    assert by_key(spark.read.table(table)) == ALL
    assert set(staged[0]) <= set(names_of(spark.read.table(table))) or elsewhere
    sinks.compact_reports(spark, table)
    assert by_key(spark.read.table(table)) == ALL
    assert (staged[1] == names_of(spark.read.table(table))) != elsewhere
    held = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    assert held == {f"year_month={r.year_month}" for r in spark.read.table(table).select("year_month").distinct().collect()}


def test_a_swap_that_fails_half_way_loses_no_row(spark, database, sides, monkeypatch):
    table = f"{database}.reports"
    target, source = sides
    sinks.upsert_reports(spark, target, table, RUN_REPROCESS)
    areas, swap = [], Staging.swap

    def torn(area, name, location):
        areas.append(area)
        swap(area, name, location)
        raise OSError("lost")

    monkeypatch.setattr(Staging, "swap", torn)
    with pytest.raises(RuntimeError, match="staged rows kept in"):
        sinks.upsert_reports(spark, source, table, RUN_REPROCESS)
    root = Path(areas[0].root.removeprefix("file:"))
    assert root.exists() and list((root / "merged-replaced").rglob("*.parquet"))
    areas[0].kept = False
    areas[0].drop()


def test_only_rows_with_known_keys_meet_the_table(spark, database, monkeypatch):
    table, met = f"{database}.reports", []
    rows = [report(f"k{i:03}", f"2024-0{1 + i % 2}", "old") for i in range(40)]
    sinks.create_reports(spark.createDataFrame(rows, schemas.REPORTS), table)
    rule = sinks.merge_all

    def seen(target, source, **options):
        met.append(source.count())
        return rule(target, source, **options)

    monkeypatch.setattr(sinks, "merge_all", seen)
    batch = [report(f"k{i:03}", "2024-02", "new") for i in range(35, 60)]
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            sinks.upsert_reports(spark, spark.createDataFrame(batch, schemas.REPORTS), table, RUN_REPROCESS)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        found = by_key(spark.read.table(table))
        assert len(found) == 60 == spark.read.table(table).count()
        assert sorted(k for k, v in found.items() if v[:2] == ("new", "2024-02")) == [f"k{i:03}" for i in range(35, 60)]
    assert met == [5, 25]
