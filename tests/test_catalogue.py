from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reportlake import schemas
from reportlake.operators import catalog, csv_import
from reportlake.operators.catalog import DESCRIPTION, MODALITY
from reportlake.operators.filters import Catalogue, Filters, active_star, filtered_reports
from reportlake.plans import dashboard
from reportlake.plans.catalogue_import import run_import

T0 = datetime(2024, 1, 1)
HEADER = ";".join(schemas.CSV_HEADERS)


def now():
    return F.lit("2024-06-01").cast("timestamp")


@pytest.fixture
def modalities(spark):
    rows = [(1, "TC", True, T0, T0), (2, "RM", True, T0, T0), (3, "tc", True, T0, T0)]
    return spark.createDataFrame(rows, schemas.MODALITIES)


@pytest.fixture
def descriptions(spark):
    rows = [(1, "Crânio", True, T0, T0), (2, "Tórax", True, T0, T0), (3, "Pelve", False, T0, T0)]
    return spark.createDataFrame(rows, schemas.DESCRIPTIONS)


@pytest.fixture
def procedures(spark):
    def row(code, ids, active=True, modality=1):
        return (code, f"p{code}", modality, *(ids + [None] * 7)[:7], active, T0, T0)

    rows = [row(1, [1, 2, 1]), row(2, []), row(3, [3]), row(4, [None, 2], False), row(5, [2], True, 2)]
    return spark.createDataFrame(rows, schemas.PROCEDURES)


def test_add_names_ignores_case_and_numbers_without_gaps(spark, descriptions):
    names = spark.createDataFrame(
        [("CRÂNIO",), ("D'Ávila",), (" d'ávila ",), ("Mão",), ("  ",), ("MÃO",), ("Pé",)], "description string"
    )
    grown = catalog.add_names(descriptions, catalog.typed_names(names, DESCRIPTION), DESCRIPTION, now())
    added = grown.filter("description_id > 3").collect()
    assert sorted(r.description_id for r in added) == [4, 5, 6]
    assert {r.description.upper() for r in added} == {"D'ÁVILA", "MÃO", "PÉ"}
    assert all(r.active and r.created_at == datetime(2024, 6, 1) for r in added)


def test_numbering_has_no_gaps_over_many_buckets(spark, descriptions):
    names = spark.range(2000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("description"))
    ids = catalog.assign_ids(descriptions, names, DESCRIPTION)
    values = sorted(r[0] for r in ids.select("description_id").collect())
    assert values == list(range(4, 2004))
    assert ids.select("description").distinct().count() == 2000


def test_empty_table_starts_at_one(spark):
    empty = spark.createDataFrame([], schemas.MODALITIES)
    names = spark.createDataFrame([("us",), ("rx",)], "modality_name string")
    grown = catalog.add_names(empty, catalog.typed_names(names, MODALITY), MODALITY, now())
    assert sorted((r.modality_id, r.modality_name) for r in grown.collect())[0][0] == 1
    assert {r.modality_name for r in grown.collect()} == {"US", "RX"}


def test_add_procedures_pads_and_cuts(spark, procedures):
    new = spark.createDataFrame(
        [(1, "taken", 1, [1]), (9, "short", 1, [5, 0]), (10, "long", 1, list(range(1, 10)))],
        "procedure_code bigint, procedure_name string, modality_id bigint, description_ids array<bigint>",
    )
    got = {r.procedure_code: r for r in catalog.add_procedures(procedures, new, now()).collect()}
    assert got[1].procedure_name == "p1" and len(got) == 7
    assert [got[9][c] for c in schemas.SLOT_COLUMNS] == [5] + [None] * 6
    assert [got[10][c] for c in schemas.SLOT_COLUMNS] == [1, 2, 3, 4, 5, 6, 7]


def test_merge_descriptions(descriptions, procedures):
    after, replaced = catalog.merge_descriptions(descriptions, procedures, 1, 2, now())
    rows = {r.procedure_code: r for r in replaced.collect()}
    assert [rows[1][c] for c in schemas.SLOT_COLUMNS[:3]] == [2, 2, 2]
    assert rows[1].updated_at == datetime(2024, 6, 1) and rows[5].updated_at == T0
    assert {r.description_id: r.active for r in after.collect()} == {1: False, 2: True, 3: False}
    assert catalog.replaced_occurrences(procedures, 1).first().occurrences == 2
    assert catalog.replaced_occurrences(procedures, 77).first().occurrences == 0
    with pytest.raises(ValueError):
        catalog.replace_description(procedures, 1, 1)


def test_delete_is_refused_while_in_use(descriptions, procedures):
    kept = catalog.delete_descriptions(descriptions, procedures.filter("procedure_code <> 3"), descriptions)
    assert {r.description_id for r in kept.collect()} == {1, 2}


def test_search_takes_a_pattern_and_ignores_nulls(spark):
    rows = spark.createDataFrame([(1, "TÓRAX"), (2, None), (3, "a.b")], "description_id int, description string")
    def ids(*a, **k):
        return [r[0] for r in catalog.search_named(rows, DESCRIPTION, *a, **k).collect()]
    assert ids("t[óo]r") == [1]
    assert ids("A.B") == [3] and ids(".", literal=True) == [3]


def test_filters_that_keep_everything_or_nothing(spark, modalities, descriptions, procedures):
    catalogue = Catalogue(modalities, descriptions, procedures)
    reports = spark.createDataFrame(
        [(c, f"k{c}", c, "HSP", T0, "2024-01") for c in (1, 2, 3, 4, 5, 99)],
        "patient_id bigint, accession_number string, procedure_code bigint, source string, performed_at timestamp, year_month string",
    )
    def codes(**filters):
        return sorted(r.procedure_code for r in filtered_reports(reports, catalogue, Filters(**filters)).collect())
    assert codes() == [1, 2, 3, 4, 5, 99]
    assert codes(sources=[]) == []
    assert codes(modalities=["TC", "RM"], modality_options=["TC", "RM"]) == [1, 2, 3, 4, 5, 99]
    assert codes(modalities=["TC"]) == [1, 2, 3]
    assert codes(descriptions=["Tórax", "Crânio"]) == [1, 5]
    assert codes(last_days=7, as_of="2024-01-09") == []
    assert codes(last_days=8, as_of="2024-01-09") == [1, 2, 3, 4, 5, 99]
    assert active_star(catalogue, Filters(descriptions=["Tórax", "Crânio"])).count() == 2
    top = dashboard.top_descriptions(reports, catalogue).collect()
    assert [(r.description, r.reports) for r in top] == [("Tórax", 2), ("Crânio", 1)]
    kpi = dashboard.kpi_row(reports.filter("false"), catalogue).first()
    assert (kpi.reports, kpi.days, kpi.mean_per_day) == (0, 0, 0.0)


def test_disjunctive_join_is_no_nested_loop(spark, modalities, descriptions, procedures, plan_of):
    catalogue = Catalogue(modalities, descriptions, procedures)
    reports = spark.createDataFrame([], "patient_id bigint, accession_number string, procedure_code bigint, source string, performed_at timestamp, year_month string")
    for query in (dashboard.top_descriptions(reports, catalogue), dashboard.kpi_row(reports, catalogue, Filters(descriptions=["x"]))):
        plan = plan_of(query)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_days_between_are_filled_with_zero(spark):
    daily = spark.sql("select date '2024-02-27' as day, 3L as reports, 2L as patients union all select date '2024-03-01', 1L, 1L")
    got = [(r.day.isoformat(), r.reports, r.patients) for r in dashboard.fill_days(daily).orderBy("day").collect()]
    assert got == [("2024-02-27", 3, 2), ("2024-02-28", 0, 0), ("2024-02-29", 0, 0), ("2024-03-01", 1, 1)]


# --- The file -------------------------------------------------------------------


def write_csv(tmp_path, lines, header=HEADER):
    path = tmp_path / "procedimentos.csv"
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_file_without_a_column_is_rejected(spark, tmp_path):
    path = write_csv(tmp_path, ["1;a"], header="CD_PROCEDIMENTO;NM_PROCEDIMENTO")
    with pytest.raises(ValueError, match="DESCRICAO_7"):
        csv_import.read_catalogue_csv(spark, path)


LINES = [
    "1;taken;TC;;;;;;;",
    "20;D'Ávila;tc;Crânio; tórax ;;   ;;;nova",
    "20;again;RM;;;;;;;",
    "21;no modality;??;;;;;;;",
    "21;now known;RM;;;;;;;",
    "21;too late;??;;;;;;;",
    "22;empty modality;;;;;;;;",
    "abc;no code;TC;;;;;;;",
]


def test_line_status_by_order(spark, tmp_path, modalities, procedures):
    lines = csv_import.read_catalogue_csv(spark, write_csv(tmp_path, LINES))
    rows = csv_import.classify_lines(lines, procedures, modalities).orderBy("line_no").collect()
    assert [r.status for r in rows] == [
        "duplicate", "inserted", "duplicate", "error", "inserted", "duplicate", "error", "error",
    ]
    counts = csv_import.import_procedures_counts(csv_import.classify_lines(lines, procedures, modalities)).first()
    assert tuple(counts) == (8, 2, 3, 3, 6)


def test_full_import(spark, database, tmp_path, modalities, descriptions, procedures):
    stored = {"modalities": modalities, "descriptions": descriptions, "procedures": procedures}
    for name, df in stored.items():
        df.write.saveAsTable(f"{database}.{name}")
    lines = csv_import.read_catalogue_csv(spark, write_csv(tmp_path, LINES))
    summary = run_import(spark, database, lines, at=now())
    assert summary["modalities"] == {"added": 1, "rejected": 3}
    assert summary["descriptions"] == {"added": 1, "rejected": 2}
    assert summary["procedures"] == {
        "lines": 8, "inserted": 2, "unknown_modality": 2, "duplicates": 4, "not_imported": 6,
    }
    again = run_import(spark, database, lines, at=now())
    assert again["procedures"]["inserted"] == 0 and again["modalities"]["added"] == 0
    done = spark.read.table(f"{database}.procedures")
    row = done.filter("procedure_code = 20").first()
    assert row.procedure_name == "D'Ávila" and row.modality_id == 1
    names = {r.description_id: r.description for r in spark.read.table(f"{database}.descriptions").collect()}
    assert [names.get(row[c]) for c in schemas.SLOT_COLUMNS] == ["Crânio", "Tórax", None, None, None, None, "nova"]
    assert {r.modality_name for r in spark.read.table(f"{database}.modalities").collect()} == {"TC", "RM", "tc", "??"}
    assert csv_import.catalogue_counts(
        *[spark.read.table(f"{database}.{n}") for n in ("modalities", "descriptions", "procedures")]
    ).first().procedures == 7


def test_file_overview(spark, tmp_path):
    lines = csv_import.read_catalogue_csv(spark, write_csv(tmp_path, LINES))
    assert tuple(csv_import.file_summary(lines).first()) == (8, 4, 3)
    assert [r.modality for r in csv_import.distinct_modalities(lines).collect()] == ["??", "RM", "TC", "tc"]
    repeated = csv_import.duplicated_codes(lines).collect()
    assert [(r.procedure_code, r.procedure_name, r.modality, r.lines) for r in repeated] == [
        (21, "no modality", "??", 3),
        (20, "D'Ávila", "tc", 2),
    ]
    assert csv_import.duplicated_lines(lines).count() == 5
    assert [r.procedure_name for r in lines.orderBy("line_no").limit(2).collect()] == ["taken", "D'Ávila"]


def test_many_codes_of_one_name_are_a_row_each(spark):
    rows = spark.range(2500).select(F.col("id").alias("procedure_code"), F.lit("same").alias("procedure_name"))
    found = csv_import.same_name_procedures(rows).collect()
    assert [tuple(r) for r in found] == [("same", 2500, code) for code in range(2500)]


def test_lines_without_a_code_repeat_each_other(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 7), (4, 8), (5, 8)], "line_no bigint, procedure_code bigint")
    assert sorted(r.line_no for r in csv_import.duplicated_lines(rows).collect()) == [1, 2, 4, 5]
    assert csv_import.duplicated_lines(rows.filter("line_no <> 1")).count() == 2
