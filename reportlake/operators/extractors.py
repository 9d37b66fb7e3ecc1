"""Finding labelled spans in a report text, by a plug-in.

An extractor maps the cleaned text column to ``struct<ok: array<extraction>, error>``.
``rule_extractor`` is built from column functions and is the default. ``python_extractor``
wraps any function from a text to extractions; it runs in Arrow batches on the executors
and turns a failure into the row's error.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions.scalars import BLANKS, bind, lstrip, non_blank, strip
from reportlake.operators.alignment import closest_span
from reportlake.operators.structure import (
    SECTION_ATTRIBUTE,
    SIGNIFICANCE_ATTRIBUTE,
    SIGNIFICANCES,
)
from reportlake.schemas import EXTRACTIONS

Extractor = Callable[[Column], Column]

# Characters per call of an extractor, and the lowest similarity at which
# an extracted text counts as found in the report.
CHARS_PER_CALL = 2000
FUZZY_THRESHOLD = 0.50

MATCH_EXACT, MATCH_FUZZY = "match_exact", "match_fuzzy"
EMPTY_TEXT = "Report text cannot be empty"


def _running_offsets(pieces: Column) -> Column:
    """Copies the growing array for every piece, so for short arrays only."""
    return F.aggregate(
        pieces,
        F.array(F.lit(0)),
        lambda starts, piece: F.concat(
            starts, F.array(F.element_at(starts, -1) + F.char_length(piece))
        ),
    )


def char_offsets(pieces: Column) -> Column:
    """Start of every piece of a text that was cut without losing a character, and its end.

    Pieces are summed in blocks of about the root of their number: no array that grows
    step by step is longer than that, however many pieces there are.
    """

    def blocks(all_: Column, size: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), size)
        return F.transform(firsts, lambda first: F.slice(all_, first, size))

    def offsets(cut: Column) -> Column:
        whole = F.transform(cut, lambda block: F.array_join(block, ""))
        return bind(_running_offsets(whole), lambda starts: F.flatten(F.transform(cut, lambda b, k: block_of(b, k, starts, cut))))

    def block_of(block: Column, k: Column, starts: Column, cut: Column) -> Column:
        own = bind(_running_offsets(block), lambda o: F.transform(o, lambda x: x + F.get(starts, k)))
        return F.when(k == F.size(cut) - 1, own).otherwise(F.slice(own, 1, F.size(block)))

    size = F.ceil(F.sqrt(F.greatest(F.size(pieces), F.lit(1)))).cast("int")
    return bind(size, lambda n: bind(blocks(pieces, n), offsets))


def _chunk_pattern(budget: int, text_end: str = r"\z") -> str:
    """At most ``budget`` characters up to a sentence or line end, else cut anywhere."""
    return (
        rf"(?s).{{1,{budget}}}(?:(?<=\n)|(?<=[.!?])(?=\s)|{text_end})|.{{1,{budget}}}"
    )


def chunks(text: Column, budget: int = CHARS_PER_CALL) -> Column:
    """array<struct<text,offset>> of at most ``budget`` characters each.

    A chunk ends after a sentence or a line where there is one; together the chunks are
    the whole text.
    """
    pieces = F.regexp_extract_all(text, F.lit(_chunk_pattern(budget)), F.lit(0))
    return bind(pieces, lambda p: bind(char_offsets(p), lambda starts: _placed(p, starts)))


def _placed(pieces: Column, starts: Column) -> Column:
    return F.transform(
        pieces, lambda piece, i: F.struct(piece.alias("text"), F.get(starts, i).alias("offset"))
    )


# --- The rule extractor ---------------------------------------------------------

HEADERS = {
    "EXAME": ("findings_prefix", "Exame"),
    "EXAMINATION": ("findings_prefix", "Exame"),
    "EXAM": ("findings_prefix", "Exame"),
    "STUDY": ("findings_prefix", "Exame"),
    "INDICAÇÃO CLÍNICA": ("findings_prefix", "Indicação"),
    "INDICAÇÃO": ("findings_prefix", "Indicação"),
    "INDICATION": ("findings_prefix", "Indicação"),
    "TÉCNICA": ("findings_prefix", "Técnica"),
    "TECHNIQUE": ("findings_prefix", "Técnica"),
    "COMPARAÇÃO": ("findings_prefix", "Comparação"),
    "COMPARISON": ("findings_prefix", "Comparação"),
    "ACHADOS": ("findings_body", None),
    "FINDINGS": ("findings_body", None),
    "IMPRESSÃO": ("findings_suffix", None),
    "IMPRESSION": ("findings_suffix", None),
    "CONCLUSÃO": ("findings_suffix", None),
    "CONCLUSION": ("findings_suffix", None),
}
ORGANS = {
    "Pulmões": "pulm|lung|pleura",
    "Coração": "cora[çc]|card[ií]a|heart",
    "Fígado": "f[ií]gado|hep[aá]tic|liver",
    "Rins": "ri[mn]|rena[li]|kidney",
    "Coluna": "colun|v[eé]rtebr|spine|disc[oa]",
    "Encéfalo": "enc[eé]fal|cerebr|brain",
}
OTHER_ORGAN = "Geral"
FINDING_WORDS = {
    "normal": "normal|preservad|sem altera|unremarkable|no evidence",
    "significant": "fratura|suspeit|malign|agud|fractur|suspicious|acute",
    "minor": "cist|leve|discret|c[aá]lcul|cyst|mild",
}

_HEADER_WORDS = "|".join(sorted(HEADERS, key=len, reverse=True))
_HEADER_AT_LINE = rf"(?mdiu)(?=^[ \t]*(?:{_HEADER_WORDS})[ \t]*:)"
_HEADER_AT_START = rf"(?iu)\A[ \t]*({_HEADER_WORDS})[ \t]*:[{BLANKS}]*"
_SENTENCE_END = r"(?<=[.!?])(?=\s)|(?<=\n)"


def at_word_start(pattern: str) -> str:
    """The pattern where a word of a lower-cased text begins."""
    return rf"(?:^|[^a-zà-ÿ])(?:{pattern})"


def _first_matching(lowered: Column, patterns: dict[str, str], default: str) -> Column:
    """Label of the first pattern found."""
    labelled = F.lit(default)
    for label, pattern in reversed(patterns.items()):
        labelled = F.when(lowered.rlike(at_word_start(pattern)), label).otherwise(labelled)
    return labelled


def _labels(lowered: Column) -> Column:
    """Organ and finding of a sentence. One search for any of their words comes first, as
    most sentences have none."""

    def labelled(organ: Column, finding: Column) -> Column:
        return F.struct(organ.alias("organ"), finding.alias("finding"))

    any_of_them = at_word_start("|".join([*ORGANS.values(), *FINDING_WORDS.values()]))
    return F.when(
        lowered.rlike(any_of_them),
        labelled(
            _first_matching(lowered, ORGANS, OTHER_ORGAN),
            _first_matching(lowered, FINDING_WORDS, SIGNIFICANCES[-1]),
        ),
    ).otherwise(labelled(F.lit(OTHER_ORGAN), F.lit(SIGNIFICANCES[-1])))


def _header_lookup(word: Column, part: int) -> Column:
    pairs = [F.lit(x) for name, found in HEADERS.items() for x in (name, found[part])]
    return F.try_element_at(F.create_map(*pairs), word)


def _span(text: Column, start: Column, cls: Column, section: Column, finding: Column) -> Column:
    """An extraction of a stripped text; ``start`` is where the unstripped one begins."""
    lead = F.char_length(text) - F.char_length(lstrip(text))
    entries = F.array(
        F.struct(F.lit(SECTION_ATTRIBUTE).alias("key"), section.alias("value")),
        F.struct(F.lit(SIGNIFICANCE_ATTRIBUTE).alias("key"), finding.alias("value")),
    )
    found = F.struct(strip(text).alias("content"), (start + lead).alias("start"))
    return bind(
        found,
        lambda f: F.struct(
            f["content"].alias("extraction_text"),
            cls.alias("extraction_class"),
            F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias(
                "attributes"
            ),
            F.struct(
                f["start"].alias("start_pos"),
                (f["start"] + F.char_length(f["content"])).alias("end_pos"),
            ).alias("char_interval"),
            F.lit(MATCH_EXACT).alias("alignment_status"),
        ),
    )


def _section_spans(section: Column) -> Column:
    """Extractions of one section: prefix whole, suffix without its header, body by sentence."""
    nothing = F.lit(None).cast("string")

    def sentences(part: Column) -> Column:
        return bind(
            F.split(part["rest"], _SENTENCE_END),
            lambda pieces: bind(
                char_offsets(pieces),
                lambda starts: F.transform(
                    _placed(pieces, starts),
                    lambda s: bind(
                        F.lower(s["text"]),
                        lambda lowered: bind(
                            _labels(lowered),
                            lambda labels: _span(
                                s["text"],
                                part["rest_start"] + s["offset"],
                                part["cls"],
                                labels["organ"],
                                labels["finding"],
                            ),
                        ),
                    ),
                ),
            ),
        )

    def spans(part: Column) -> Column:
        whole = F.array(_span(part["text"], part["start"], part["cls"], part["label"], nothing))
        tail = F.array(_span(part["rest"], part["rest_start"], part["cls"], nothing, nothing))
        return (
            F.when(part["cls"] == "findings_prefix", whole)
            .when(part["cls"] == "findings_suffix", tail)
            .otherwise(sentences(part))
        )

    def known(cut: Column) -> Column:
        return F.struct(
            cut["text"].alias("text"),
            cut["offset"].alias("start"),
            cut["rest"].alias("rest"),
            (cut["offset"] + F.char_length(cut["text"]) - F.char_length(cut["rest"])).alias(
                "rest_start"
            ),
            F.coalesce(_header_lookup(cut["word"], 0), F.lit("findings_body")).alias("cls"),
            _header_lookup(cut["word"], 1).alias("label"),
        )

    cut = F.struct(
        section["text"].alias("text"),
        section["offset"].alias("offset"),
        F.regexp_replace(section["text"], _HEADER_AT_START, "").alias("rest"),
        F.upper(F.regexp_extract(section["text"], _HEADER_AT_START, 1)).alias("word"),
    )
    return bind(cut, lambda c: bind(known(c), spans))


def rule_spans(text: Column) -> Column:
    """Headers cut the text into sections and sentence ends cut the findings."""
    sections = bind(
        F.split(text, _HEADER_AT_LINE),
        lambda pieces: bind(char_offsets(pieces), lambda starts: _placed(pieces, starts)),
    )
    spans = F.flatten(F.transform(sections, _section_spans))
    return F.filter(spans, lambda e: e["extraction_text"] != "")


def rule_extractor(text: Column) -> Column:
    usable = non_blank(text)
    return F.struct(
        F.when(usable, rule_spans(text)).cast(EXTRACTIONS).alias("ok"),
        F.when(~usable, EMPTY_TEXT).alias("error"),
    )


# --- Python plug-ins ------------------------------------------------------------

_SPAN_TYPE = T.StructType(
    [T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
)
_EXTRACTION_TYPE = T.StructType(
    [
        T.StructField("extraction_text", T.StringType()),
        T.StructField("extraction_class", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("char_interval", _SPAN_TYPE),
        T.StructField("alignment_status", T.StringType()),
    ]
)
_RESULT_TYPE = T.StructType(
    [
        T.StructField("ok", T.ArrayType(_EXTRACTION_TYPE)),
        T.StructField("error", T.StringType()),
    ]
)
_FIELDS = _EXTRACTION_TYPE.fieldNames()


def _text(value, field: str) -> str | None:
    if value is not None and not isinstance(value, str):
        raise TypeError(f"{field} is not text: {value!r}")
    return value


def _attributes(value) -> dict[str, str | None] | None:
    """Text by text; a list of texts is joined, any other value is refused."""
    if value is None:
        return None
    if not isinstance(value, dict):
        raise TypeError(f"attributes are not a mapping: {value!r}")
    out = {}
    for key, one in value.items():
        if isinstance(one, (list, tuple)):
            one = ", ".join(_text(x, f"an item of attribute {key}") or "" for x in one)
        out[_text(key, "an attribute's name") or ""] = _text(one, f"attribute {key}")
    return out


def _interval(value, offset: int) -> dict | None:
    """Both ends as whole numbers of 32 bits, else none."""
    if not isinstance(value, dict):
        return None
    ends = []
    for name in ("start_pos", "end_pos"):
        one = value.get(name)
        if isinstance(one, str) and re.fullmatch(r"\s*[+-]?[0-9]{1,10}\s*", one):
            one = int(one)
        if isinstance(one, float) and one.is_integer():
            one = int(one)
        if isinstance(one, bool) or not isinstance(one, int) or abs(one + offset) >= 1 << 31:
            return None
        ends.append(one + offset)
    return dict(zip(("start_pos", "end_pos"), ends))


def checked(found: dict, offset: int) -> dict:
    """An answer in the types of ``_EXTRACTION_TYPE``, its interval moved by ``offset``.

    An interval that isn't one becomes null; any other badly typed field is an error, which
    then is the error of its report.
    """
    if not isinstance(found, dict):
        raise TypeError(f"an extraction is not a mapping: {found!r}")
    out = {name: _text(found.get(name), name) for name in (_FIELDS[0], _FIELDS[1], _FIELDS[4])}
    out["attributes"] = _attributes(found.get("attributes"))
    out["char_interval"] = _interval(found.get("char_interval"), offset)
    return out


def python_extractor(
    extract: Callable[[str], list[dict]], budget: int | None = CHARS_PER_CALL
) -> Extractor:
    """An extractor from a function of one text, called on chunks of ``budget`` characters.

    Intervals the function gives are relative to its chunk and are moved to the report.
    The budget decides what the function sees at once: what crosses a cut is never seen
    whole. Without one the function gets each report in one piece.
    """

    cut = re.compile(_chunk_pattern(budget, r"\Z") if budget else r"(?s).+")

    def one_report(text) -> dict:
        if text is None or not text.strip():
            return {"ok": None, "error": EMPTY_TEXT}
        try:
            return {"ok": [e for part in cut.finditer(text) for e in one_chunk(part)], "error": None}
        except Exception as problem:
            return {"ok": None, "error": str(problem) or type(problem).__name__}

    def one_chunk(part: re.Match) -> list[dict]:
        if not part.group().strip():
            return []
        return [checked(found, part.start()) for found in extract(part.group())]

    @F.pandas_udf(_RESULT_TYPE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one_report(t) for t in texts], columns=["ok", "error"])

    # Marked so that Spark calls it once per row instead of copying it to where it is used.
    return run.asNondeterministic()


# --- Alignment ------------------------------------------------------------------


def locate_exact(text: Column, wanted: Column) -> Column:
    """Interval of the first occurrence, in characters; null when there is none."""
    start = F.position(wanted, text)
    return F.when(
        (F.char_length(wanted) > 0) & (start > 0),
        F.struct(
            (start - 1).alias("start_pos"), (start - 1 + F.char_length(wanted)).alias("end_pos")
        ),
    )


@F.pandas_udf(T.ArrayType(_SPAN_TYPE))
def _closest_spans(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    def one(text, missing):
        if text is None or missing is None:
            return None
        return [closest_span(text, w, FUZZY_THRESHOLD) if w else None for w in missing]

    return pd.Series([one(t, w) for t, w in zip(texts, wanted)], dtype=object)


# Marked so that Spark calls it once per row instead of copying it to where it is used.
_closest_spans = _closest_spans.asNondeterministic()


def _with_span(extraction: Column, span: Column, status: str) -> Column:
    found = extraction["char_interval"].isNull() & span.isNotNull()
    return F.struct(
        *[extraction[f].alias(f) for f in _FIELDS[:3]],
        F.coalesce(extraction["char_interval"], span).alias("char_interval"),
        F.when(found, status).otherwise(extraction["alignment_status"]).alias("alignment_status"),
    )


def align_exact(extractions: Column, text: Column) -> Column:
    """Fills missing intervals where the extracted text stands in the report."""
    return F.transform(
        extractions,
        lambda e: _with_span(e, locate_exact(text, e["extraction_text"]), MATCH_EXACT),
    )


def align(reports: DataFrame, text: str, extractions: str = "extractions") -> DataFrame:
    """Fills missing intervals: exactly where possible, else by the fewest changed words.

    Only reports that still have an open extraction are sent to Python.
    """
    exact = reports.withColumn(extractions, align_exact(F.col(extractions), F.col(text)))
    open_texts = F.transform(
        extractions, lambda e: F.when(e["char_interval"].isNull(), e["extraction_text"])
    )
    needed = F.exists("__open", lambda t: t.isNotNull())
    sent = exact.withColumn("__open", open_texts).withColumn(
        "__spans", _closest_spans(F.when(needed, F.col(text)), F.when(needed, F.col("__open")))
    )
    filled = F.transform(
        extractions, lambda e, i: _with_span(e, F.get("__spans", i), MATCH_FUZZY)
    )
    return sent.withColumn(
        extractions, F.when(F.col("__spans").isNotNull(), filled).otherwise(F.col(extractions))
    ).drop("__open", "__spans")
