import json

import pytest
from pyspark.sql import functions as F

from reportlake.operators import extractors, prompts, structure
from reportlake.plans.structuring import structure_texts, structured_reports
from reportlake.schemas import EXTRACTIONS


def found(text, cls="findings_body", section=None, finding=None, span=None):
    attributes = {k: v for k, v in (("section", section), ("clinical_significance", finding)) if v is not None}
    return (text, cls, attributes, span, None)


def segments_of(spark, extractions):
    row = spark.createDataFrame([(extractions,)], f"e {EXTRACTIONS}")
    return row.withColumn("s", structure.organize(structure.segments_of(F.col("e"))))


def rendered(spark, extractions, **options):
    return segments_of(spark, extractions).select(structure.render(F.col("s"), **options)).first()[0]


def test_unknown_classes_go_and_labels_default_to_the_type(spark):
    (row,) = segments_of(spark, [
        found("a", " Findings_BODY ", section=""),
        found("b", "other"),
        found("c", "findings_suffix", finding="NORMAL"),
    ]).collect()
    assert [(s.type, s.label, s.significance) for s in row.s] == [("body", "body", None), ("suffix", "suffix", "normal")]


@pytest.mark.parametrize("span, kept", [((3, 9), [(3, 9)]), ((3, None), []), ((None, 9), []), (None, [])])
def test_intervals_need_both_ends(spark, span, kept):
    (row,) = segments_of(spark, [found("a", span=span)]).collect()
    assert [tuple(i) for i in row.s[0].intervals] == kept


def test_body_labels_are_gathered_and_the_rest_keeps_its_order(spark):
    (row,) = segments_of(spark, [
        found("s1", "findings_suffix", "z"),
        found("1", section="Lungs"),
        found("2", section="Liver"),
        found("p1", "findings_prefix", "x"),
        found("3", section="Lungs"),
        found("p2", "findings_prefix", "y"),
        found("p3", "findings_prefix", "x"),
    ]).collect()
    assert [s.content for s in row.s] == ["p1", "p2", "p3", "1", "3", "2", "s1"]


def test_plain_and_padded_repeats(spark):
    text = rendered(spark, [
        found("same", section="L"), found("same", section="L"), found(" same ", section="L"), found("other", section="L"),
    ])
    assert text == "FINDINGS:\n\nL: same same other"


def test_prefix_alone_plain(spark):
    assert rendered(spark, [found("one", "findings_prefix"), found("two ", "findings_prefix", "PREFIX")]) == "one\n\ntwo"


def test_headed_prefix_and_all_sections(spark):
    text = rendered(spark, [
        found("exam: Head CT", "findings_prefix", "Examination"),
        found("Fast slices", "findings_prefix", "Technique"),
        found("Clear.", section="Lungs"),
        found("Fine.", "findings_suffix"),
        found("Again.", "findings_suffix", "x"),
    ])
    assert text == (
        "EXAMINATION:\n\nHead CT\n\nFast slices\n\n\nFINDINGS:\n\nLungs: Clear.\n\nIMPRESSION:\n\nFine.\nAgain."
    )


def test_examination_labels_are_a_choice(spark):
    exam = [found("EXAM: Head", "findings_prefix", "Exame")]
    assert rendered(spark, exam) == "EXAM: Head"
    assert rendered(spark, exam, examination_labels=("examination", "exame")) == "EXAMINATION:\n\nHead"


def test_suffix_alone_and_after_plain_prefix(spark):
    assert rendered(spark, [found("x", "findings_suffix")]) == "IMPRESSION:\n\nx"
    both = [found("p", "findings_prefix"), found("x", "findings_suffix")]
    assert rendered(spark, both) == "p\n\nIMPRESSION:\n\nx"
    assert rendered(spark, []) == ""


@pytest.mark.parametrize(
    "text, expected",
    [("STUDY: x", "x"), ("exam:EXAM: y", "EXAM: y"), ("  z ", "z"), ("EXAMINED: a", "EXAMINED: a")],
)
def test_exam_word(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(structure.strip_exam_word(F.col("t"))).first()[0] == expected


REPORT = (
    "EXAME: TC de tórax\nIndicação: dor.\n\nACHADOS:\nPulmões normais. Fígado com cisto 1.5 cm.\n"
    "Pulmões normais.\nRins\nIMPRESSÃO:\n1. Cisto 𝛼.\n2. Resto normal."
)


def reports(spark, *texts):
    rows = [(str(i), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "accession_number string, report_text string")


def test_rule_extractor_spans_are_the_text(spark):
    (row,) = structure_texts(reports(spark, REPORT)).collect()
    for e in row.extractions:
        assert row.clean_text[e.char_interval.start_pos : e.char_interval.end_pos] == e.extraction_text
    assert [(e.extraction_class, e.attributes.get("section")) for e in row.extractions] == [
        ("findings_prefix", "Exame"),
        ("findings_prefix", "Indicação"),
        ("findings_body", "Pulmões"),
        ("findings_body", "Fígado"),
        ("findings_body", "Pulmões"),
        ("findings_body", "Rins"),
        ("findings_suffix", None),
    ]
    assert json.loads(row.segments_json)[0] == {
        "type": "prefix", "label": "Exame", "content": "EXAME: TC de tórax",
        "intervals": [{"startPos": 0, "endPos": 18}], "significance": None,
    }


def test_rule_extractor_stays_in_the_jvm(spark, plan_of):
    plan = plan_of(structure_texts(reports(spark, REPORT), repair=False))
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_and_failing_reports_are_kept_with_their_error(spark):
    def picky(text):
        if "bad" in text:
            raise ValueError("cannot read this")
        return [{"extraction_text": text.strip(), "extraction_class": "findings_body"}]

    rows = structured_reports(
        reports(spark, "good", "bad", "***  \n- "), extractors.python_extractor(picky), model="m"
    ).orderBy("accession_number").collect()
    assert rows[0].formatted_text == "FINDINGS:\n\nbody: good" and rows[0].raw_prompt != ""
    assert rows[1].formatted_text == "Error processing report: cannot read this"
    assert (rows[1].segments_json, rows[1].annotated_document_json, rows[1].raw_prompt) == ("[]", "{}", "")
    only_dash = structured_reports(reports(spark, "- ")).first()
    assert only_dash.formatted_text == "Error processing report: Report text cannot be empty"


@pytest.mark.parametrize("budget", [1, 7, 40, 2000])
def test_chunks_are_the_whole_text(spark, budget):
    row = spark.createDataFrame([(REPORT,)], "t string")
    parts = row.select(extractors.chunks(F.col("t"), budget)).first()[0]
    assert "".join(p.text for p in parts) == REPORT
    assert all(REPORT[p.offset : p.offset + len(p.text)] == p.text for p in parts)
    assert max(len(p.text) for p in parts) <= budget


def test_python_extractor_moves_chunk_intervals(spark):
    def words(text):
        at = text.find("Rins")
        if at < 0:
            return []
        return [{"extraction_text": "Rins", "extraction_class": "findings_body", "char_interval": {"start_pos": at, "end_pos": at + 4}}]

    (row,) = structure_texts(reports(spark, REPORT), extractors.python_extractor(words, 30)).collect()
    (one,) = row.extractions
    assert row.clean_text[one.char_interval.start_pos : one.char_interval.end_pos] == "Rins"


def test_alignment_exact_then_close_then_none(spark):
    def guess(text):
        return [
            {"extraction_text": "Fígado com cisto 1.5 cm.", "extraction_class": "findings_body"},
            {"extraction_text": "Figado com cisto 1.5 cm.", "extraction_class": "findings_body"},
            {"extraction_text": "something else entirely", "extraction_class": "findings_body"},
        ]

    (row,) = structure_texts(reports(spark, REPORT), extractors.python_extractor(guess, None)).collect()
    exact, close, none = row.extractions
    assert exact.alignment_status == "match_exact" and close.alignment_status == "match_fuzzy"
    assert tuple(exact.char_interval) == tuple(close.char_interval)
    assert none.char_interval is None and none.alignment_status is None


def test_closest_span_threshold():
    text = "one two three four five"
    assert extractors.closest_span(text, "two tree") == {"start_pos": 4, "end_pos": 13}
    assert extractors.closest_span(text, "six tree") is None
    assert extractors.closest_span("", "x") is None
    assert extractors.closest_span("A b", "a B c d") is not None


def test_prompt(spark):
    examples = prompts.load_examples()
    whole = prompts.prompt_text(examples, "the {report}")
    assert whole.count("<example number=") == len(examples) and "# Your report" in whole
    assert "null" not in whole and "char_interval" not in whole
    assert "# Your report" not in prompts.prompt_text(examples)
    row = spark.createDataFrame([("the {report}",)], "t string")
    assert row.select(prompts.prompt_column(F.col("t"))).first()[0] == whole
    shown = prompts.examples_frame(spark).collect()
    assert len(shown) == len(examples)
    assert all(e.extraction_text in r.text for r in shown for e in r.extractions)
