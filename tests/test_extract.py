import hashlib
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from checks.extraction import digest, with_digest
from checks.standins import Data
from reportlake import schemas
from reportlake.functions import scalars
from reportlake.operators import extract
from reportlake.schemas import RUN_DAILY, RUN_REPROCESS


def performed(spark, rows):
    return spark.createDataFrame(rows, schemas.PERFORMED)


def test_processing_window():
    assert extract.processing_window(RUN_DAILY, "2025-11-18") == (date(2025, 11, 18), date(2025, 11, 19))
    assert extract.processing_window(RUN_REPROCESS, "2025-11-18", 7) == (
        date(2025, 11, 11),
        date(2025, 11, 19),
    )
    assert extract.processing_window(RUN_REPROCESS, "2025-11-18", 0)[0] == date(2025, 11, 18)
    yesterday = extract.processing_window(RUN_DAILY, today=date(2025, 1, 1))
    assert yesterday == (date(2024, 12, 31), date(2025, 1, 1))
    with pytest.raises(ValueError):
        extract.processing_window(RUN_DAILY, "18/11/2025")


def test_accession_key_has_no_separator_and_ignores_nulls(spark):
    rows = spark.createDataFrame([(1, 23, 4), (12, 3, 4), (None, 5, 6)], "a bigint, b bigint, c bigint")
    got = rows.select(
        scalars.accession_key("a", "b", "c").alias("k"),
        scalars.accession_key("a", "b", "c", separator="-").alias("s"),
    ).collect()
    assert [r.k for r in got] == ["1234", "1234", "56"]
    assert [r.s for r in got] == ["1-23-4", "12-3-4", "-5-6"]


@pytest.mark.parametrize(
    "seconds, expected",
    [
        ("abc", datetime(2024, 1, 31)),
        (None, datetime(2024, 1, 31)),
        (" 12 ", datetime(2024, 1, 31, 0, 0, 12)),
        ("86400", datetime(2024, 2, 1)),
        ("90000.5", datetime(2024, 2, 1, 1, 0, 0, 500000)),
        ("-1", datetime(2024, 1, 30, 23, 59, 59)),
        ("NaN", datetime(2024, 1, 31)),
        ("12d", datetime(2024, 1, 31)),
    ],
)
def test_day_plus_seconds(spark, seconds, expected):
    row = spark.createDataFrame([(date(2024, 1, 31), seconds)], "d date, s string")
    assert row.select(scalars.day_plus_seconds("d", "s")).first()[0] == expected


@pytest.mark.parametrize(
    "text, expected",
    [(None, False), ("", False), ("   ", False), ("\n\t", False), (" ", False), ("\x1c", False), (" a ", True)],
)
def test_non_blank(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(scalars.non_blank("t")).first()[0] is expected


def test_same_rows_are_kept_every_time_and_hot_keys_are_reduced_first(spark, plan_of):
    day = date(2024, 5, 1)
    rows = performed(
        spark,
        [(1, 23, 4, c, day, "10", "HSP") for c in range(50)] + [(12, 3, 4, 7, day, "5", "HSP")],
    )
    encounters = spark.createDataFrame([(1, 100, "HSP"), (12, 200, "HSP")], schemas.ENCOUNTERS)
    texts = spark.createDataFrame(
        [(1, 23, 4, "text", "HSP"), (12, 3, 4, "other", "HSP")], schemas.REPORT_TEXTS
    )
    extracted = extract.extract_reports(rows, encounters, texts, None)
    assert extracted.count() == 51
    kept = extract.one_per_accession(extracted)
    assert plan_of(kept).count("WindowGroupLimit") == 2
    for shuffled in (extracted, extracted.repartition(7)):
        (row,) = extract.one_per_accession(shuffled).collect()
        assert (row.accession_number, row.encounter_id, row.procedure_code) == ("1234", 1, 0)
    strict = extract.extract_reports(rows, encounters, texts, None, strict_key=True)
    assert extract.one_per_accession(strict).count() == 2
    (collision,) = extract.key_collisions(extracted).collect()
    assert tuple(collision) == ("1234", 2)


def test_text_stays_behind_when_nobody_asks_for_it(spark, plan_of):
    day = date(2024, 5, 1)
    rows = performed(spark, [(1, 2, 3, 4, day, "1", "HSP")])
    encounters = spark.createDataFrame([(1, 100, "HSP")], schemas.ENCOUNTERS)
    texts = spark.createDataFrame([(1, 2, 3, "text", "HSP")], schemas.REPORT_TEXTS)
    kept = extract.one_per_accession(extract.extract_reports(rows, encounters, texts, None))
    plan = plan_of(kept.groupBy("source").count())
    above_exchange = plan[: plan.rindex("Exchange hashpartitioning(accession")]
    assert "report_text" not in above_exchange


def test_a_procedure_can_match_reports_of_both_systems(spark):
    day = date(2024, 5, 1)
    rows = performed(spark, [(1, 2, 3, 4, day, "1", "HSP")])
    encounters = spark.createDataFrame([(1, 100, "HSP"), (1, 300, "PSC")], schemas.ENCOUNTERS)
    texts = spark.createDataFrame(
        [(1, 2, 3, "h", "HSP"), (1, 2, 3, "p", "PSC")], schemas.REPORT_TEXTS
    )
    loose = extract.attach_reports(rows, encounters, texts).collect()
    assert {(r.source, r.patient_id, r.report_text) for r in loose} == {
        ("HSP", 100, "h"),
        ("PSC", 300, "p"),
    }
    (strict,) = extract.attach_reports(rows, encounters, texts, strict_source=True).collect()
    assert (strict.source, strict.patient_id) == ("HSP", 100)


def test_window_filter_reaches_the_scan(spark, plan_of, tmp_path):
    path = str(tmp_path / "performed")
    performed(spark, [(1, 2, 3, 4, date(2024, 5, 1), "1", "HSP")]).write.parquet(path)
    read = spark.read.parquet(path)
    plan = plan_of(extract.performed_in_window(read, None, "2024-05-01", "2024-06-01").select("order_no"), brief=False)
    assert "GreaterThanOrEqual(performed_date,2024-05-01)" in plan
    assert "LessThan(performed_date,2024-06-01)" in plan
    assert "procedure_code" not in plan


def test_stamp_gives_the_table_columns(spark):
    day = date(2024, 5, 1)
    rows = performed(spark, [(1, 2, 3, 4, day, "1", "HSP")])
    encounters = spark.createDataFrame([(1, 100, "HSP")], schemas.ENCOUNTERS)
    texts = spark.createDataFrame([(1, 2, 3, "text", "HSP")], schemas.REPORT_TEXTS)
    kept = extract.one_per_accession(extract.extract_reports(rows, encounters, texts, None))
    stamped = extract.stamp(kept, RUN_DAILY, F.lit("2024-06-01").cast("timestamp"))
    assert stamped.columns == schemas.REPORTS.fieldNames()
    row = stamped.first()
    assert (row.run_mode, row.loaded_at, row.year_month) == (RUN_DAILY, datetime(2024, 6, 1), "2024-05")


MOVES_NO_TEXT = [
    "performed_with_report",
    "extracted_rows",
    "extracted_rows_strict_source",
    "extracted_rows_in_window",
    "deduplicated_reports",
    "deduplicated_reports_strict_key",
    "upsert_daily",
    "upsert_daily_by_lookup",
    "upsert_reprocess",
    "upsert_reprocess_by_lookup",
]


@pytest.mark.parametrize("name", MOVES_NO_TEXT)
def test_digests_of_texts_are_taken_where_these_are_read(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"), brief=False)
    moved = re.findall(r"\(\d+\) Exchange\s*\n(?:Input|Output)[^\n]*", plan)
    assert moved and not any("report_text" in line for line in moved)


def test_columns_of_the_text_come_with_the_same_rows(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5, 9, "HSP"), (1, 2, 5, 9, "PSC"), (1, 2, 5, 9, "PSC"), (None, 1, 5, 9, "HSP")],
        "encounter_id long, occurrence_no long, order_no long, procedure_code long, source string",
    )
    encounters = spark.createDataFrame(
        [(1, 7, "HSP"), (1, 8, "PSC"), (1, 8, "PSC"), (None, 9, "HSP")], "encounter_id long, patient_id long, source string"
    )
    reports = spark.createDataFrame(
        [(1, 1, 5, "HSP", "a"), (1, 1, 5, "PSC", "b"), (1, 2, 5, "PSC", "c"), (1, 2, 5, "HSP", " \n"), (None, 1, 5, "HSP", "d")],
        "encounter_id long, occurrence_no long, order_no long, source string, report_text string",
    )
    for strict in (False, True):
        whole = extract.attach_reports(rows, encounters, reports, strict)
        narrow = extract.attach_reports(rows, encounters, reports, strict, of_text={"size": F.length("report_text")})
        wanted = whole.withColumn("size", F.length("report_text"))
        columns = sorted(wanted.columns)
        assert sorted(map(tuple, narrow.select(columns).collect())) == sorted(map(tuple, wanted.select(columns).collect()))
        assert narrow.count() == (5 if strict else 7)


def test_counts_without_texts_move_a_procedure_once_and_no_hash(spark, plan_of):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(Data(spark, "/root/testdata/sf0.001").reports.select("accession_number", "patient_id"), brief=False)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\(\d+\) Exchange\s*\n(?:Input|Output)[^\n]*", plan)
    assert moved and not any(extract.TEXT_HASH in line for line in moved)
    assert not any("patient_id" in line and "performed_seconds" in line for line in moved)


def test_distinct_reports_meet_their_encounters_where_they_are(spark, plan_of, tmp_path):
    keys = [(1, 1, 5, "O"), (1, 1, 5, "O"), (1, 2, 5, "F"), (None, 1, 5, "O"), (2, 3, 5, None)]
    lines = spark.createDataFrame(
        [(k, n, s, 9, None, status) for k, n, s, status in keys],
        "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate timestamp, l_linestatus string",
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    reports = Data(spark, str(tmp_path)).table("report")
    encounters = spark.createDataFrame([(1, 7, "HSP")], "encounter_id long, patient_id long, source string")
    met = extract.usable_texts(reports).join(encounters.hint("merge"), ["encounter_id", "source"])
    # reports are gathered once, encounters once
    assert plan_of(met).count("Exchange hashpartitioning(encounter_id") == 2
    assert sorted(map(tuple, reports.collect())) == [(1, 1, 5, "HSP", "a"), (1, 2, 5, "PSC", "a"), (2, 3, 5, "PSC", "a")]
    assert [(r.encounter_id, r.occurrence_no, r.patient_id) for r in met.collect()] == [(1, 1, 7)]


def test_digests_move_as_bytes_and_come_out_as_digits(spark):
    rows = spark.createDataFrame([("é a",), (None,)], "report_text string")
    moved = rows.withColumns(digest())
    assert dict(moved.dtypes)["text_md5"] == "binary"
    wanted = [(hashlib.md5("é a".encode()).hexdigest(), 3), (None, None)]
    for have in (rows, moved):  # the digest made late, or where the text was read
        assert [tuple(r) for r in with_digest(have).select("text_md5", "text_chars").collect()] == wanted
