"""From labelled extractions to ordered segments and the formatted report.

A report carries its extractions in an array, so everything here is evaluated row by
row inside the JVM: no shuffle, however the reports are distributed. ``segment_rows``
and ``segment_positions`` are the same first steps for extractions held one per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.scalars import (
    BLANKS,
    bind,
    empty_to_null,
    rstrip,
    strip,
    to_json_keeping_nulls,
)
from reportlake.schemas import EXTRACTIONS, INTERVALS

# Section types by extraction class, attribute names, headers, labels.
PREFIX, BODY, SUFFIX = "prefix", "body", "suffix"
SECTION_CLASSES = {
    "findings_prefix": PREFIX,
    "findings_body": BODY,
    "findings_suffix": SUFFIX,
}
SECTION_ATTRIBUTE = "section"
SIGNIFICANCE_ATTRIBUTE = "clinical_significance"
SIGNIFICANCES = ("normal", "minor", "significant", "not_applicable")
FINDINGS_HEADER = "FINDINGS:"
IMPRESSION_HEADER = "IMPRESSION:"
EXAMINATION_HEADER = "EXAMINATION:"
EXAMINATION_LABELS = ("examination",)
EXAM_WORDS = ("EXAMINATION:", "EXAM:", "STUDY:")
ERROR_PREFIX = "Error processing report: "


def section_type(extraction_class: Column) -> Column:
    """Section of an extraction class; null for classes that are not one."""
    cleaned = F.lower(strip(extraction_class))
    out = F.lit(None).cast("string")
    for name, kind in SECTION_CLASSES.items():
        out = F.when(cleaned == name, kind).otherwise(out)
    return out


def section_label(section: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(section, F.lit("")), kind)


def significance(value: Column) -> Column:
    return F.lower(value)


def intervals(start: Column, end: Column) -> Column:
    """One interval when both ends are whole numbers, otherwise none."""
    first, last = start.try_cast("int"), end.try_cast("int")
    one = F.array(F.struct(first.alias("startPos"), last.alias("endPos")))
    none = F.array().cast(INTERVALS)
    return F.when(first.isNotNull() & last.isNotNull(), one).otherwise(none)


# --- One extraction per row -----------------------------------------------------


def segment_rows(extractions: DataFrame) -> DataFrame:
    """Segments from rows (doc_id, pos, extraction_text, extraction_class, section,
    clinical_significance, start_pos, end_pos); rows of unknown class are dropped."""
    kind = section_type(F.col("extraction_class"))
    return (
        extractions.withColumn("type", kind)
        .filter(F.col("type").isNotNull())
        .select(
            "doc_id",
            "pos",
            "type",
            section_label(F.col("section"), F.col("type")).alias("label"),
            F.col("extraction_text").alias("content"),
            intervals(F.col("start_pos"), F.col("end_pos")).alias("intervals"),
            significance(F.col("clinical_significance")).alias("significance"),
        )
    )


def segment_positions(segments: DataFrame) -> DataFrame:
    """Sort keys of the presentation order: (type_rank, label_pos, pos).

    A body label stands where it first appears in its report; the first positions are
    found by partial aggregation and joined back, so no report is gathered in one task.
    """
    first = segments.groupBy("doc_id", "type", "label").agg(F.min("pos").alias("__first"))
    rank = F.when(F.col("type") == PREFIX, 0).when(F.col("type") == BODY, 1).otherwise(2)
    return (
        segments.join(first, ["doc_id", "type", "label"])
        .withColumn("type_rank", rank)
        .withColumn(
            "label_pos", F.when(F.col("type") == BODY, F.col("__first")).otherwise(F.col("pos"))
        )
        .drop("__first")
    )


# --- All extractions of a report in one array -----------------------------------


def segments_of(extractions: Column) -> Column:
    """array<extraction> to array<segment>, in extraction order."""
    kept = F.filter(extractions, lambda e: section_type(e["extraction_class"]).isNotNull())
    return F.transform(kept, _segment)


def _segment(extraction: Column) -> Column:
    kind = section_type(extraction["extraction_class"])
    attributes = extraction["attributes"]
    span = extraction["char_interval"]
    return F.struct(
        kind.alias("type"),
        section_label(F.try_element_at(attributes, F.lit(SECTION_ATTRIBUTE)), kind).alias("label"),
        extraction["extraction_text"].alias("content"),
        intervals(span["start_pos"], span["end_pos"]).alias("intervals"),
        significance(F.try_element_at(attributes, F.lit(SIGNIFICANCE_ATTRIBUTE))).alias(
            "significance"
        ),
    )


def _of_type(items: Column, kind: str) -> Column:
    return F.filter(items, lambda s: s["type"] == kind)


def organize(segments: Column) -> Column:
    """Prefix, then body gathered by label as labels first appear, then suffix."""

    def by_label(body: Column) -> Column:
        labels = F.array_distinct(F.transform(body, lambda s: s["label"]))
        return F.flatten(
            F.transform(labels, lambda label: F.filter(body, lambda s: s["label"] == label))
        )

    return bind(
        segments,
        lambda all_: F.concat(
            _of_type(all_, PREFIX), bind(_of_type(all_, BODY), by_label), _of_type(all_, SUFFIX)
        ),
    )


def distinct_contents(contents: Column) -> Column:
    """Stripped contents without repeats.

    A content is a repeat when an earlier one, stripped, equals it as it stands; a
    padded repeat therefore stays.
    """

    def marked(raw: Column) -> Column:
        """Sorted by stripped content, so that repeats stand next to each other."""
        return F.array_sort(
            F.transform(
                raw,
                lambda c, i: bind(
                    strip(c),
                    lambda s: F.struct(s.alias("content"), i.alias("at"), (c != s).alias("padded")),
                ),
            )
        )

    def first_ones(found: Column) -> Column:
        kept = F.filter(
            found,
            lambda x, k: x["content"].isNotNull()
            & (
                x["padded"]
                | (k == 0)
                | ~F.get(found, k - 1)["content"].eqNullSafe(x["content"])
            ),
        )
        return F.transform(
            F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["content"].alias("content")))),
            lambda x: x["content"],
        )

    return bind(bind(contents, marked), first_ones)


def group_contents(segments: Column) -> Column:
    """array<struct<type,label,contents>> by (type, label) in order of appearance."""

    def groups(all_: Column) -> Column:
        keys = F.array_distinct(
            F.transform(
                all_, lambda s: F.struct(s["type"].alias("type"), s["label"].alias("label"))
            )
        )
        return F.transform(keys, lambda key: group(all_, key))

    def group(all_: Column, key: Column) -> Column:
        own = F.filter(
            all_, lambda s: (s["type"] == key["type"]) & (s["label"] == key["label"])
        )
        return F.struct(
            key["type"].alias("type"),
            key["label"].alias("label"),
            distinct_contents(F.transform(own, lambda s: s["content"])).alias("contents"),
        )

    return bind(segments, groups)


def strip_exam_word(text: Column) -> Column:
    """Without a leading EXAMINATION:, EXAM: or STUDY:, once."""
    words = "|".join(EXAM_WORDS)
    return strip(F.regexp_replace(text, rf"(?iU)\A(?:{words})[{BLANKS}]*", ""))


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def _lines(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _not_empty(contents: Column) -> Column:
    return F.filter(contents, lambda c: c != "")


def _all_contents(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: g["contents"]))


def _prefix_parts(groups: Column, examination_labels: Iterable[str]) -> Column:
    named = F.exists(
        groups, lambda g: (g["label"] != "") & (F.lower(g["label"]) != PREFIX)
    )

    def headed(group: Column) -> Column:
        contents = group["contents"]
        examined = F.concat(
            _lines(EXAMINATION_HEADER, ""),
            _not_empty(F.transform(contents, strip_exam_word)),
            _lines(""),
        )
        is_examination = F.lower(group["label"]).isin(list(examination_labels))
        return F.when(is_examination, examined).otherwise(
            F.concat(_not_empty(contents), _lines(""))
        )

    plain = bind(
        _all_contents(groups),
        lambda contents: F.when(
            F.size(contents) > 0, F.array(rstrip(F.array_join(contents, "\n\n")))
        ).otherwise(_empty_strings()),
    )
    return F.when(named, F.flatten(F.transform(groups, headed))).otherwise(plain)


def _body_parts(groups: Column, before: Column) -> Column:
    def line(group: Column) -> Column:
        joined = strip(F.array_join(group["contents"], " "))
        return bind(
            joined,
            lambda text: F.when(
                text != "", F.array(F.concat(group["label"], F.lit(": "), text), F.lit(""))
            ).otherwise(_empty_strings()),
        )

    gap = F.when(F.size(before) > 0, _lines("")).otherwise(_empty_strings())
    block = F.concat(gap, _lines(FINDINGS_HEADER, ""), F.flatten(F.transform(groups, line)))
    return F.when(F.size(groups) > 0, block).otherwise(_empty_strings())


def _suffix_parts(groups: Column, before: Column) -> Column:
    last = F.get(before, F.size(before) - 1)
    gap = F.when(F.coalesce(strip(last) != "", F.lit(False)), _lines("")).otherwise(
        _empty_strings()
    )
    lines = rstrip(F.array_join(_all_contents(groups), "\n"))
    block = F.concat(gap, _lines(IMPRESSION_HEADER, ""), F.array(lines))
    return F.when(F.size(groups) > 0, block).otherwise(_empty_strings())


def render(segments: Column, examination_labels: Iterable[str] = EXAMINATION_LABELS) -> Column:
    """The formatted report of organised segments."""

    def then(before: Column, parts) -> Column:
        return F.concat(before, parts(before))

    def text(groups: Column) -> Column:
        prefix = _prefix_parts(_of_type(groups, PREFIX), examination_labels)
        with_body = bind(
            prefix, lambda p: then(p, lambda b: _body_parts(_of_type(groups, BODY), b))
        )
        whole = bind(
            with_body, lambda p: then(p, lambda b: _suffix_parts(_of_type(groups, SUFFIX), b))
        )
        return rstrip(F.array_join(whole, "\n"))

    return bind(group_contents(segments), text)


def pruned_json(extraction: Column) -> Column:
    """An extraction as JSON without nulls and without what is empty at any depth."""
    span = extraction["char_interval"]
    known = span["start_pos"].isNotNull() | span["end_pos"].isNotNull()
    return F.to_json(
        F.struct(
            extraction["extraction_text"].alias("extraction_text"),
            extraction["extraction_class"].alias("extraction_class"),
            empty_to_null(extraction["attributes"]).alias("attributes"),
            F.when(known, span).alias("char_interval"),
            extraction["alignment_status"].alias("alignment_status"),
        )
    )


def annotated_document_json(extractions: Column) -> Column:
    return to_json_keeping_nulls(F.struct(extractions.cast(EXTRACTIONS).alias("extractions")))


def segments_json(segments: Column) -> Column:
    return to_json_keeping_nulls(segments)


def build_response(
    reports: DataFrame,
    extractions: str = "extractions",
    error: str = "error",
    examination_labels: Iterable[str] = EXAMINATION_LABELS,
) -> DataFrame:
    """Adds segments, annotated document and formatted text.

    A row with an error gets no segments, an empty document and the message as text.
    """
    failed = F.col(error).isNotNull()
    organised = reports.withColumn(
        "segments", organize(segments_of(F.coalesce(F.col(extractions), F.array().cast(EXTRACTIONS))))
    )
    return organised.withColumns(
        {
            "segments_json": F.when(failed, "[]").otherwise(segments_json(F.col("segments"))),
            "annotated_document_json": F.when(failed, "{}").otherwise(
                annotated_document_json(F.col(extractions))
            ),
            "formatted_text": F.when(failed, F.concat(F.lit(ERROR_PREFIX), F.col(error))).otherwise(
                render(F.col("segments"), examination_labels)
            ),
        }
    )
