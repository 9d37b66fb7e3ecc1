import pytest
from pyspark.sql import functions as F

from reportlake.operators.extractors import EMPTY_TEXT, python_extractor
from reportlake.plans import structuring

GOOD = {"extraction_text": "a", "extraction_class": "findings_body", "attributes": {"section": "Lungs"}}
BROKEN = {
    "number as attribute": {**GOOD, "attributes": {"section": 3}},
    "attributes as text": {**GOOD, "attributes": "Lungs"},
    "number as text": {**GOOD, "extraction_text": 5},
    "nested attribute": {**GOOD, "attributes": {"section": {"a": 1}}},
    "no mapping": "a",
}
MENDED = {
    "words as interval": ({**GOOD, "char_interval": {"start_pos": "a", "end_pos": "b"}}, None),
    "half an interval": ({**GOOD, "char_interval": {"start_pos": "a", "end_pos": None}}, None),
    "interval as text": ({**GOOD, "char_interval": "0-1"}, None),
    "huge interval": ({**GOOD, "char_interval": {"start_pos": 1 << 40, "end_pos": 1 << 41}}, None),
    "digits": ({**GOOD, "char_interval": {"start_pos": "0", "end_pos": 1.0}}, (0, 1)),
    "list as attribute": ({**GOOD, "attributes": {"section": ["Lungs", "Heart"]}}, None),
}


def run(spark, answers):
    def extract(text):
        return [answers[text]] if text in answers else 1 / 0

    rows = spark.createDataFrame([(k,) for k in [*answers, "fails", "", None]], "text string").coalesce(1)
    found = rows.select("text", python_extractor(extract)(F.col("text")).alias("x")).select("text", "x.*")
    return {r.text: r for r in found.collect()}


def test_a_badly_typed_answer_is_the_error_of_its_row(spark):
    found = run(spark, {**BROKEN, "good": GOOD})
    assert found["good"].error is None and found["good"].ok[0].attributes == {"section": "Lungs"}
    for name in BROKEN:
        assert found[name].ok is None and found[name].error
    assert "division" in found["fails"].error
    assert found[""].error == found[None].error == EMPTY_TEXT


def test_a_bad_interval_is_dropped(spark):
    found = run(spark, {k: v for k, (v, _) in MENDED.items()})
    for name, (_, span) in MENDED.items():
        assert found[name].error is None
        got = found[name].ok[0].char_interval
        assert (got and tuple(got)) == span
    assert found["list as attribute"].ok[0].attributes == {"section": "Lungs, Heart"}


def test_a_long_error_is_kept_whole(spark):
    def extract(text):
        raise ValueError("x" * 5000)

    rows = spark.createDataFrame([("a",)], "text string")
    assert len(rows.select(python_extractor(extract)(F.col("text"))["error"]).first()[0]) == 5000


@pytest.mark.parametrize("limit, rows", [(None, 150), (7, 7)])
def test_every_report_is_structured_without_a_limit(spark, limit, rows):
    reports = spark.range(150).select(
        F.format_string("%04d", "id").alias("accession_number"),
        F.lit("FINDINGS: normal lungs.").alias("report_text"),
        F.lit("2024-01-01").cast("timestamp").alias("performed_at"),
    )
    assert structuring.select_reports(reports, limit=limit).count() == rows
