"""Text normalisation and report structuring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.standins import Data, kept, own_table, with_standins
from reportlake.functions import text as cleaning
from reportlake.functions.scalars import strip
from reportlake.operators import extractors, structure
from reportlake.operators.prompts import load_examples, prompt_column, prompt_text
from reportlake.plans.structuring import run_structuring, select_reports, structure_texts, structured_reports
from reportlake.schemas import EXTRACTIONS
from reportlake.sources.sinks import create_reports

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
RSTRIP = r"regexp_replace({}, '\s+$', '')"

# --- Normalisation --------------------------------------------------------------


def symbols_sql(column: str) -> str:
    out = column
    for symbol, words in cleaning.SYMBOLS.items():
        out = f"replace({out}, '{symbol}', '{words}')"
    return out


STEPS = {
    "symbols": (cleaning.replace_symbols, symbols_sql("text")),
    "blanks": (cleaning.collapse_blanks, r"regexp_replace(text, '[ \t]+', ' ', 'g')"),
    "line_ends": (cleaning.unify_line_ends, r"regexp_replace(text, '\r\n?', chr(10), 'g')"),
    "empty_lines": (
        cleaning.collapse_empty_lines,
        r"regexp_replace(text, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')",
    ),
    "outer_blanks": (strip, STRIP.format("text")),
    "wrappers": (
        cleaning.drop_wrappers,
        r"""regexp_replace(regexp_replace(text, '(?i)---\s*BEGIN [^-]+---\n*', '', 'g'),
              '(?i)\n*---\s*END [^-]+---\s*', '', 'g')""",
    ),
    "star_headers": (
        cleaning.star_headers_to_colons,
        r"regexp_replace(text, '\*{3}\s*([^*]+?)\s*\*{3}', '\1:', 'g')",
    ),
    "bullets": (
        cleaning.drop_line_bullets,
        r"regexp_replace(text, '(?m)^[ \t]*[*\x{2022}\x{25CF}-]+\s*', '', 'g')",
    ),
    "numbering": (
        cleaning.unify_line_numbers,
        r"regexp_replace(text, '(?m)^[ \t]*(\d+)[).][ \t]+', '\1. ', 'g')",
    ),
}


def _chain(names: list[str], column: str, table: str = "messy") -> str:
    """The steps' SQL applied one after the other, as nested subqueries."""
    source = f"select doc_id, {column} as text from {table}"
    for name in names:
        source = f"select doc_id, {STEPS[name][1]} as text from ({source})"
    return source


SANITIZE = ["symbols", "blanks", "line_ends", "empty_lines", "outer_blanks"]
NORMALIZE = ["wrappers", "star_headers", "bullets", "numbering", "outer_blanks"]
MESSY = with_standins("messy")

for _name, (_function, _sql) in STEPS.items():
    query(f"text_{_name}", MESSY + f"select doc_id, {_sql} as text from messy")(
        lambda data, f=_function: data.table("messy").select("doc_id", f("text").alias("text"))
    )


@query("sanitize_text", MESSY + _chain(SANITIZE, "text"))
def _(data: Data) -> DataFrame:
    cleaned = cleaning.sanitize_text("text", repair=False)
    return data.table("messy").select("doc_id", cleaned.alias("text"))


@query("normalize_structure", MESSY + _chain(NORMALIZE, "text"))
def _(data: Data) -> DataFrame:
    cleaned = cleaning.normalize_structure("text")
    return data.table("messy").select("doc_id", cleaned.alias("text"))


@query("preprocess_report", MESSY + _chain(SANITIZE + NORMALIZE, "text"))
def _(data: Data) -> DataFrame:
    cleaned = cleaning.preprocess_report("text", repair=False)
    return data.table("messy").select("doc_id", cleaned.alias("text"))


# The texts are damaged in ways the repair undoes, so the originals are the result.
@query("repair_unicode", "select doc_id, nfc_normalize(text) as text from documents")
def _(data: Data) -> DataFrame:
    damaged = F.col("text")
    for whole, broken in (("é", "Ã©"), ("ê", "ê"), ("fi", "ﬁ")):
        damaged = F.replace(damaged, F.lit(whole), F.lit(broken))
    # Entities are resolved only in texts without a tag.
    entities = F.replace(damaged, F.lit("à"), F.lit("&agrave;"))
    damaged = F.when(F.contains("text", F.lit("<")), damaged).otherwise(entities)
    return data.base("documents").select(
        "doc_id", cleaning.repair_unicode(damaged).alias("text")
    )


# Read by a wrong code page: whole texts once or twice, or the second half alone.
@query("repair_wrong_code_page", "select doc_id, nfc_normalize(text) as text from documents")
def _(data: Data) -> DataFrame:
    def misread(text):
        return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")

    text, half = F.col("text"), F.floor(F.char_length("text") / 2).cast("int")
    first, second = F.substring("text", 1, half), F.substring("text", half + 1, F.char_length("text"))
    kind = F.col("doc_id") % 3
    damaged = F.when(kind == 0, misread(text)).when(kind == 1, misread(misread(text))).otherwise(
        F.concat(first, misread(second))
    )
    return data.base("documents").select("doc_id", cleaning.repair_unicode(damaged).alias("text"))


# --- Segments from one extraction per row ---------------------------------------

SEGMENTS = (
    with_standins("extraction")
    + rf""", typed as (select *, case lower({STRIP.format('extraction_class')})
        when 'findings_prefix' then 'prefix' when 'findings_body' then 'body'
        when 'findings_suffix' then 'suffix' end as type from extraction),
  segment as (select doc_id, pos, type, coalesce(nullif(section, ''), type) as label,
      extraction_text as content,
      case when start_pos is not null and end_pos is not null
        then start_pos || '-' || end_pos else '' end as intervals,
      lower(clinical_significance) as significance
    from typed where type is not null)
"""
)


def _interval_text(segments: DataFrame) -> DataFrame:
    shown = F.transform(
        "intervals", lambda i: F.concat_ws("-", i["startPos"].cast("string"), i["endPos"].cast("string"))
    )
    return segments.withColumn("intervals", F.array_join(shown, ","))


@query("segment_rows", SEGMENTS + "select * from segment")
def _(data: Data) -> DataFrame:
    return _interval_text(structure.segment_rows(data.table("extraction")))


@query(
    "segment_positions",
    SEGMENTS
    + """select doc_id, pos, type, label,
           (case type when 'prefix' then 0 when 'body' then 1 else 2 end)::bigint as type_rank,
           case when type = 'body' then min(pos) over (partition by doc_id, type, label)
                else pos end as label_pos
         from segment""",
)
def _(data: Data) -> DataFrame:
    segments = structure.segment_rows(data.table("extraction"))
    return structure.segment_positions(segments).select(
        "doc_id", "pos", "type", "label", "type_rank", "label_pos"
    )


@query(
    "segments_per_section",
    SEGMENTS
    + """select type, label, significance, count(*) as segments from segment group by 1, 2, 3""",
)
def _(data: Data) -> DataFrame:
    segments = structure.segment_rows(data.table("extraction"))
    return segments.groupBy("type", "label", "significance").agg(F.count("*").alias("segments"))


# --- All extractions of a report in an array ------------------------------------
# Every document is a report whose sentences are its extractions. Some sentences come
# again, exactly or padded; classes, sections, spans and significance vary by position.


def document_extractions(data: Data) -> DataFrame:
    doc = F.col("doc_id")

    def extraction(piece, i):
        content = (
            F.when((i == 0) & (doc % 4 == 0), F.concat(F.lit("Exam: "), piece))
            .when(i % 7 == 3, F.concat(F.lit(" "), F.get("pieces", F.lit(0)), F.lit(" ")))
            .when(i % 7 == 5, F.get("pieces", F.lit(1)))
            .otherwise(piece)
        )
        cls = (
            F.when((i == 0) & (doc % 3 != 0), " Findings_Prefix ")
            .when((i == 1) & (doc % 4 == 0), "findings_prefix")
            .when((doc + i) % 11 == 10, "other")
            .when(i % 5 == 4, "findings_suffix")
            .otherwise("findings_body")
        )
        kind = (doc + i * 7) % 5
        section = (
            F.when((i == 0) & (doc % 4 == 0), "Examination")
            .when((i == 0) & (doc % 4 == 1), F.lit(None).cast("string"))
            .when((i == 1) & (doc % 4 == 0), "Technique")
            .when(kind == 0, "Lungs")
            .when(kind == 1, "Liver")
            .when(kind == 2, "Spine")
            .when(kind == 3, "")
        )
        level = (doc * 3 + i) % 4
        finding = (
            F.when(level == 0, "normal").when(level == 1, "Minor").when(level == 2, "SIGNIFICANT")
        )
        start = F.when(i % 3 != 0, (i * 10).cast("int"))
        end = F.when(i % 4 != 3, (i * 10 + 5).cast("int"))
        entries = F.array(
            F.struct(F.lit("section").alias("key"), section.alias("value")),
            F.struct(F.lit("clinical_significance").alias("key"), finding.alias("value")),
        )
        return F.struct(
            content.alias("extraction_text"),
            cls.alias("extraction_class"),
            F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias(
                "attributes"
            ),
            F.struct(start.alias("start_pos"), end.alias("end_pos")).alias("char_interval"),
            F.lit(None).cast("string").alias("alignment_status"),
        )

    pieces = data.base("documents").select("doc_id", F.split("text", "[.] ").alias("pieces"))
    return pieces.select("doc_id", F.transform("pieces", extraction).alias("extractions"))


DOCUMENT_SEGMENTS = rf"""with cut as (
    select doc_id, string_split(text, '. ') as pieces from documents),
  numbered as (select doc_id, pieces, unnest(range(len(pieces))) as i from cut),
  extraction as (select doc_id, i,
      case when i = 0 and doc_id % 4 = 0 then 'Exam: ' || pieces[i + 1]
        when i % 7 = 3 then ' ' || pieces[1] || ' '
        when i % 7 = 5 then pieces[2] else pieces[i + 1] end as content,
      case when i = 0 and doc_id % 3 <> 0 then ' Findings_Prefix '
        when i = 1 and doc_id % 4 = 0 then 'findings_prefix'
        when (doc_id + i) % 11 = 10 then 'other' when i % 5 = 4 then 'findings_suffix'
        else 'findings_body' end as class,
      case when i = 0 and doc_id % 4 = 0 then 'Examination'
        when i = 0 and doc_id % 4 = 1 then null
        when i = 1 and doc_id % 4 = 0 then 'Technique'
        else case (doc_id + i * 7) % 5 when 0 then 'Lungs' when 1 then 'Liver'
          when 2 then 'Spine' when 3 then '' end end as section,
      case (doc_id * 3 + i) % 4 when 0 then 'normal' when 1 then 'Minor'
        when 2 then 'SIGNIFICANT' end as finding,
      case when i % 3 <> 0 then i * 10 end as start_pos,
      case when i % 4 <> 3 then i * 10 + 5 end as end_pos
    from numbered),
  typed as (select *, case lower({STRIP.format('class')}) when 'findings_prefix' then 'prefix'
      when 'findings_body' then 'body' when 'findings_suffix' then 'suffix' end as type
    from extraction),
  segment as (select doc_id, i as pos, type, coalesce(nullif(section, ''), type) as label,
      content, lower(finding) as significance, start_pos, end_pos,
      case type when 'prefix' then 0 when 'body' then 1 else 2 end as rank
    from typed where type is not null),
  marked as (select *, {STRIP.format('content')} as stripped,
      min(pos) over (partition by doc_id, type, label) as first,
      min(pos) over (partition by doc_id, type, label, {STRIP.format('content')}) as first_same
    from segment),
  grouped as (select doc_id, type, label, rank, first, list(stripped order by pos) as contents
    from marked where content <> stripped or pos = first_same group by 1, 2, 3, 4, 5)
"""


def organised(data: Data) -> DataFrame:
    found = document_extractions(data)
    return found.withColumn("segments", structure.organize(structure.segments_of(F.col("extractions"))))


@query(
    "organised_segments",
    DOCUMENT_SEGMENTS
    + """select doc_id, row_number() over (partition by doc_id order by rank,
             case when type = 'body' then first else pos end, pos) - 1 as n,
           type, label, md5(content) as content_md5, significance,
           case when start_pos is not null and end_pos is not null
             then start_pos || '-' || end_pos else '' end as intervals from marked""",
)
def _(data: Data) -> DataFrame:
    rows = organised(data).select("doc_id", F.posexplode("segments").alias("n", "s"))
    return _interval_text(rows.select("doc_id", "n", "s.*")).withColumn(
        "content_md5", F.md5("content")
    ).drop("content")


@query(
    "grouped_contents",
    DOCUMENT_SEGMENTS
    + """select doc_id, row_number() over (partition by doc_id order by rank, first) - 1 as n,
           type, label, len(contents) as contents,
           md5(array_to_string(contents, '|')) as contents_md5 from grouped""",
)
def _(data: Data) -> DataFrame:
    groups = structure.group_contents(F.col("segments"))
    rows = organised(data).select("doc_id", F.posexplode(groups).alias("n", "g"))
    return rows.select(
        "doc_id",
        "n",
        "g.type",
        "g.label",
        F.size("g.contents").alias("contents"),
        F.md5(F.array_join("g.contents", "|")).alias("contents_md5"),
    )


RENDERED = (
    DOCUMENT_SEGMENTS
    + rf""", parts as (select *, case
        when type = 'prefix' and lower(label) = 'examination' then ['EXAMINATION:', '']
          || list_filter(list_transform(contents, lambda c: {STRIP.format(
              "regexp_replace(c, '(?i)^(EXAMINATION:|EXAM:|STUDY:)" + r"\s*', '')")}),
              lambda c: c <> '') || ['']
        when type = 'prefix' then list_filter(contents, lambda c: c <> '') || ['']
        when type = 'body' and {STRIP.format("array_to_string(contents, ' ')")} <> ''
          then [label || ': ' || {STRIP.format("array_to_string(contents, ' ')")}, '']
        else []::varchar[] end as shown from grouped),
  sections as (select doc_id,
      bool_or(type = 'prefix' and lower(label) <> 'prefix') as named,
      flatten(list(shown order by first) filter (type = 'prefix')) as headed,
      flatten(list(contents order by first) filter (type = 'prefix')) as plain,
      flatten(list(shown order by first) filter (type = 'body')) as body,
      flatten(list(contents order by first) filter (type = 'suffix')) as suffix
    from parts group by 1),
  with_prefix as (select *, case when named then headed when plain is null then []::varchar[]
      else [{RSTRIP.format("array_to_string(plain, chr(10) || chr(10))")}] end as p from sections),
  with_body as (select *, p || case when body is null then []::varchar[]
      else (case when len(p) > 0 then [''] else []::varchar[] end) || ['FINDINGS:', ''] || body end
      as pb from with_prefix),
  whole as (select *, pb || case when suffix is null then []::varchar[]
      else (case when len(pb) > 0 and {STRIP.format("pb[len(pb)]")} <> '' then ['']
            else []::varchar[] end)
        || ['IMPRESSION:', '', {RSTRIP.format("array_to_string(suffix, chr(10))")}] end as lines
    from with_body)
  select doc_id, coalesce({RSTRIP.format("array_to_string(lines, chr(10))")}, '') as formatted_text
    from documents left join whole using (doc_id)"""
)


@query("rendered_reports", RENDERED)
def _(data: Data) -> DataFrame:
    # A report none of whose extractions has a known class renders to nothing.
    return organised(data).select("doc_id", structure.render(F.col("segments")).alias("formatted_text"))


@query(
    "examination_without_its_word",
    rf"""select doc_id, {STRIP.format(
        "regexp_replace('study:  ' || text, '(?i)^(EXAMINATION:|EXAM:|STUDY:)" + r"\s*', '')")}
        as text from documents""",
)
def _(data: Data) -> DataFrame:
    labelled = F.concat(F.lit("study:  "), F.col("text"))
    return data.base("documents").select("doc_id", structure.strip_exam_word(labelled).alias("text"))


@query(
    "segments_json",
    DOCUMENT_SEGMENTS
    + """, listed as (select doc_id, to_json(list({'type': type, 'label': label, 'content': content,
           'intervals': case when start_pos is not null and end_pos is not null
             then [{'startPos': start_pos, 'endPos': end_pos}] else [] end,
           'significance': significance}
           order by rank, case when type = 'body' then first else pos end, pos))::varchar
           as segments_json from marked group by 1)
         select doc_id, coalesce(segments_json, '[]') as segments_json
         from documents left join listed using (doc_id)""",
)
def _(data: Data) -> DataFrame:
    return organised(data).select("doc_id", structure.segments_json(F.col("segments")).alias("segments_json"))


@query(
    "annotated_document_json",
    DOCUMENT_SEGMENTS
    + """select doc_id, to_json({'extractions': list({'extraction_text': content,
           'extraction_class': class, 'attributes': map_from_entries(list_filter(
             [{'k': 'section', 'v': section}, {'k': 'clinical_significance', 'v': finding}],
             lambda e: e.v is not null)),
           'char_interval': {'start_pos': start_pos, 'end_pos': end_pos},
           'alignment_status': null} order by i)})::varchar as annotated_document_json
         from extraction group by 1""",
)
def _(data: Data) -> DataFrame:
    json = structure.annotated_document_json(F.col("extractions"))
    return document_extractions(data).select("doc_id", json.alias("annotated_document_json"))


@query(
    "pruned_extractions",
    DOCUMENT_SEGMENTS
    + """select doc_id, i::bigint as n, json_merge_patch('{}', to_json({'extraction_text': content, 'extraction_class': class,
           'attributes': nullif(map_from_entries(list_filter(
             [{'k': 'section', 'v': section}, {'k': 'clinical_significance', 'v': finding}],
             lambda e: e.v is not null)), map([]::varchar[], []::varchar[])),
           'char_interval': case when start_pos is not null or end_pos is not null
             then {'start_pos': start_pos, 'end_pos': end_pos} end,
           'alignment_status': null}))::varchar as json from extraction""",
)
def _(data: Data) -> DataFrame:
    rows = document_extractions(data).select("doc_id", F.posexplode("extractions").alias("n", "e"))
    return rows.select("doc_id", "n", structure.pruned_json(F.col("e")).alias("json"))


# --- Extraction -----------------------------------------------------------------

HEADED = with_standins("headed")
_WORDS = "|".join(sorted(extractors.HEADERS, key=len, reverse=True))
_AT_START = rf"(?i)^[ \t]*({_WORDS})[ \t]*:\s*"


def _header_case(part: int) -> str:
    whens = " ".join(
        f"when '{word}' then " + (f"'{found[part]}'" if found[part] else "null")
        for word, found in extractors.HEADERS.items()
    )
    return f"case word {whens} end"


def _first_matching_sql(patterns: dict[str, str], default: str) -> str:
    whens = " ".join(
        f"when regexp_matches(lower(piece), '{extractors.at_word_start(pattern)}') then '{label}'"
        for label, pattern in patterns.items()
    )
    return f"case {whens} else '{default}' end"


def _rule_spans_sql(table: str) -> str:
    return rf""", marked as (select doc_id, string_split(regexp_replace(text,
        '(?mi)^[ \t]*(?:{_WORDS})[ \t]*:', chr(1) || '\0', 'g'), chr(1)) as sections from {table}),
  section as (select doc_id, unnest(range(len(sections))) as n, sections from marked),
  placed as (select doc_id, n, sections[n + 1] as section, coalesce(sum(length(sections[n + 1]))
      over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0)
      as start, upper(regexp_extract(sections[n + 1], '{_AT_START}', 1)) as word,
      regexp_replace(sections[n + 1], '{_AT_START}', '') as rest from section),
  known as (select *, coalesce({_header_case(0)}, 'findings_body') as class,
      {_header_case(1)} as label, start + length(section) - length(rest) as rest_start
    from placed),
  sentence as (select *, unnest(range(len(pieces))) as m from (select *, string_split(
      regexp_replace(regexp_replace(rest, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'),
        '\n', chr(10) || chr(1), 'g'), chr(1)) as pieces from known where class = 'findings_body')),
  body as (select doc_id, n, m, pieces[m + 1] as piece, class,
      rest_start + coalesce(sum(length(pieces[m + 1])) over (partition by doc_id, n order by m
        rows between unbounded preceding and 1 preceding), 0) as start from sentence),
  spans as (
    select doc_id, n, 0 as m, section as piece, class, start, label as section,
      null::varchar as finding from known where class = 'findings_prefix'
    union all
    select doc_id, n, 0, rest, class, rest_start, null, null from known
      where class = 'findings_suffix'
    union all
    select doc_id, n, m, piece, class, start,
      {_first_matching_sql(extractors.ORGANS, extractors.OTHER_ORGAN)},
      {_first_matching_sql(extractors.FINDING_WORDS, 'not_applicable')} from body),
  found as (select doc_id, {STRIP.format('piece')} as content, class, section, finding,
      (start + length(piece) - length(regexp_replace(piece, '^\s+', '')))::bigint as start_pos,
      n, m
    from spans)
"""


RULE_SPANS = HEADED + _rule_spans_sql("headed")


def headed(data: Data) -> DataFrame:
    return data.table("headed")


@query(
    "rule_spans",
    RULE_SPANS
    + """select doc_id, row_number() over (partition by doc_id order by n, m) - 1 as n,
           md5(content) as content_md5, class, section, finding, start_pos::bigint as start_pos,
           (start_pos + length(content))::bigint as end_pos from found where content <> ''""",
)
def _(data: Data) -> DataFrame:
    spans = extractors.rule_spans(F.col("text"))
    rows = headed(data).select("doc_id", F.posexplode(spans).alias("n", "e"))
    return rows.select(
        "doc_id",
        "n",
        F.md5("e.extraction_text").alias("content_md5"),
        F.col("e.extraction_class").alias("class"),
        F.try_element_at("e.attributes", F.lit("section")).alias("section"),
        F.try_element_at("e.attributes", F.lit("clinical_significance")).alias("finding"),
        F.col("e.char_interval.start_pos").alias("start_pos"),
        F.col("e.char_interval.end_pos").alias("end_pos"),
    )


@query(
    "located_sentences",
    r"""with cut as (select doc_id, text, string_split(text, '. ') as pieces from documents),
        piece as (select doc_id, text, pieces, unnest(range(len(pieces))) as n from cut)
        select doc_id, n, (strpos(text, pieces[n + 1]) - 1)::bigint as start_pos,
          (strpos(text, pieces[n + 1]) - 1 + length(pieces[n + 1]))::bigint as end_pos
        from piece where pieces[n + 1] <> ''""",
)
def _(data: Data) -> DataFrame:
    pieces = data.base("documents").select("doc_id", "text", F.split("text", "[.] ").alias("p"))
    spans = F.transform("p", lambda piece: extractors.locate_exact(F.col("text"), piece))
    rows = pieces.select("doc_id", F.posexplode(spans).alias("n", "s")).filter("s is not null")
    return rows.select("doc_id", "n", "s.start_pos", "s.end_pos")


# The first ten words, the fifth misspelt: they are found at the start.
_FIRST_WORDS = r"regexp_extract(text, '^(\s*)((?:\S+\s+){9}\S+)', 2)"


@query(
    "aligned_damaged_sentences",
    rf"""with cut as (select doc_id, text, {_FIRST_WORDS} as start from documents where {_FIRST_WORDS} <> '')
        select doc_id, 'match_fuzzy' as status, (strpos(text, start) - 1)::bigint as start_pos,
          (strpos(text, start) - 1 + length(start))::bigint as end_pos from cut""",
)
def _(data: Data) -> DataFrame:
    words = F.split(F.regexp_replace("text", r"^\s+", ""), r"\s+")
    long = data.base("documents").select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 10)
    damaged = F.transform(F.slice("w", 1, 10), lambda word, i: F.when(i == 4, F.concat(word, F.lit("‡"))).otherwise(word))
    found = F.array(
        F.struct(
            F.array_join(damaged, " ").alias("extraction_text"),
            F.lit("findings_body").alias("extraction_class"),
            F.lit(None).alias("attributes"),
            F.lit(None).alias("char_interval"),
            F.lit(None).alias("alignment_status"),
        )
    ).cast(EXTRACTIONS)
    done = extractors.align(long.withColumn("extractions", found), "text")
    one = F.get("extractions", 0)
    return done.filter(F.col("w")[9] != "").select(
        "doc_id", one["alignment_status"].alias("status"), one["char_interval"]["start_pos"].alias("start_pos"),
        one["char_interval"]["end_pos"].alias("end_pos"),
    )


# A chunk is the longest stretch of at most 500 characters that ends behind a line end, or
# behind . ! or ? before white space or the end of the text; without one, 500 characters.
@query(
    "text_chunks",
    r"""with recursive step as (
          select doc_id, text as rest, 0 as start, '' as chunk, -1 as n from documents
          union all
          select doc_id, substr(rest, size + 1), start + size, substr(rest, 1, size), n + 1
          from (select *, case when length(rest) <= 500 then length(rest)
                when ends = '' then 500 else length(replace(ends, chr(1), '')) end as size
            from (select *, regexp_replace(regexp_replace(replace(regexp_replace(
                  substr(rest, 1, 501), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'),
                  chr(10), chr(10) || chr(1)), '(?s)\x01$', ''), '[^\x01]*$', '') as ends
              from step where rest <> '')))
        select doc_id, n::bigint as n, (start - length(chunk))::bigint as "offset",
          length(chunk)::bigint as size, md5(chunk) as chunk_md5 from step where n >= 0""",
)
def _(data: Data) -> DataFrame:
    parts = data.base("documents").select("doc_id", F.posexplode(extractors.chunks(F.col("text"), 500)).alias("n", "c"))
    size = F.char_length("c.text").cast("bigint").alias("size")
    return parts.select("doc_id", "n", F.col("c.offset").alias("offset"), size, F.md5("c.text").alias("chunk_md5"))


_HEAD, _TAIL = prompt_text(load_examples(), "{report}").split("{report}")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "prompts",
    f"select doc_id, {_literal(_HEAD)} || text || {_literal(_TAIL)} as prompt from documents",
)
def _(data: Data) -> DataFrame:
    return data.base("documents").select("doc_id", prompt_column(F.col("text")).alias("prompt"))


# --- The job --------------------------------------------------------------------


def as_reports(data: Data) -> DataFrame:
    """The headed documents as rows of the report table."""
    return headed(data).select(
        F.col("doc_id").cast("string").alias("accession_number"),
        F.col("text").alias("report_text"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
        .cast("timestamp")
        .alias("performed_at"),
    )


@query(
    "selected_reports",
    HEADED
    + """select doc_id::varchar as accession_number, text as report_text from headed
         where date '2000-01-01' + (doc_id % 400)::integer >= date '2000-03-01'
           and date '2000-01-01' + (doc_id % 400)::integer < date '2000-09-01'
         order by accession_number limit 100""",
)
def _(data: Data) -> DataFrame:
    return select_reports(as_reports(data), "2000-03-01", "2000-09-01", 100)


SECTIONS = r""", segment as (select doc_id, content, n * 1000000 + m as pos, finding,
      start_pos, start_pos + length(content) as end_pos,
      case class when 'findings_prefix' then 'prefix' when 'findings_body' then 'body'
        else 'suffix' end as type,
      coalesce(section, case class when 'findings_suffix' then 'suffix' end) as label
    from found where content <> ''),
  grouped as (select doc_id, type, label, min(pos) as first,
      list(content order by pos) as contents
    from (select *, row_number() over (partition by doc_id, type, label, content order by pos) as k
          from segment) where k = 1 group by 1, 2, 3),
  sections as (select doc_id,
      array_to_string(list(array_to_string(contents, chr(10)) || chr(10) order by first)
        filter (type = 'prefix'), chr(10)) as prefix,
      array_to_string(list(label || ': ' || array_to_string(contents, ' ') || chr(10)
        order by first) filter (type = 'body'), chr(10)) as body,
      array_to_string(flatten(list(contents order by first) filter (type = 'suffix')), chr(10))
        as suffix from grouped group by 1),
  formatted as (select doc_id, prefix || chr(10) || chr(10) || 'FINDINGS:' || chr(10)
      || chr(10) || body || chr(10) || 'IMPRESSION:' || chr(10) || chr(10) || suffix
      as formatted_text from sections)
"""


@query(
    "structured_texts",
    RULE_SPANS
    + SECTIONS
    + "select doc_id::varchar as accession_number, formatted_text from formatted",
)
def _(data: Data) -> DataFrame:
    done = structure_texts(as_reports(data), clean=False)
    return done.select("accession_number", "formatted_text")


@query(
    "structured_reports",
    HEADED
    + f", prepared as ({_chain(SANITIZE + NORMALIZE, 'nfc_normalize(text)', 'headed')})"
    + _rule_spans_sql("prepared")
    + SECTIONS
    + f""", ordered as (select *, case type when 'prefix' then 0 when 'body' then 1 else 2 end as rank,
      case when type = 'body' then min(pos) over (partition by doc_id, type, label) else pos end
        as label_pos from segment),
  segments as (select doc_id, to_json(list({{'type': type, 'label': label, 'content': content,
      'intervals': [{{'startPos': start_pos, 'endPos': end_pos}}], 'significance': finding}}
      order by rank, label_pos, pos))::varchar as segments_json from ordered group by 1),
  annotated as (select doc_id, to_json({{'extractions': list({{'extraction_text': content,
      'extraction_class': class, 'attributes': map_from_entries(list_filter(
        [{{'k': 'section', 'v': section}}, {{'k': 'clinical_significance', 'v': finding}}],
        lambda e: e.v is not null)),
      'char_interval': {{'start_pos': start_pos, 'end_pos': start_pos + length(content)}},
      'alignment_status': 'match_exact'}} order by n, m)}})::varchar as annotated_document_json
    from found where content <> '' group by 1)
  select doc_id::varchar as accession_number, segments_json, annotated_document_json,
    formatted_text, {_literal(_HEAD)} || text || {_literal(_TAIL)} as raw_prompt,
    'rules' as model, 0.0::double as temperature, '2001-01-01 00:00:00' as loaded_at
  from prepared join formatted using (doc_id) join segments using (doc_id)
    join annotated using (doc_id)""",
)
def _(data: Data) -> DataFrame:
    return structured_reports(
        select_reports(as_reports(data), limit=0),
        loaded_at=F.lit("2001-01-01 00:00:00").cast("timestamp"),
    )


# All reports, then those of one month again by another model: the others keep their rows.
@query(
    "structured_through_table",
    HEADED
    + f", prepared as ({_chain(SANITIZE + NORMALIZE, 'nfc_normalize(text)', 'headed')})"
    + _rule_spans_sql("prepared")
    + SECTIONS
    + """, dated as (select doc_id, strftime(date '2000-01-01' + (doc_id % 400)::integer, '%Y-%m') as year_month
      from prepared)
  select doc_id::varchar as accession_number, formatted_text, year_month,
    case when year_month = '2000-03' then 'second' else 'rules' end as model
  from dated join formatted using (doc_id)""",
)
def _(data: Data) -> DataFrame:
    with own_table(data) as reports, own_table(data) as output:
        create_reports(as_reports(data).withColumn("year_month", F.date_format("performed_at", "yyyy-MM")), reports)
        run_structuring(data.spark, reports, output, upsert=True)
        run_structuring(data.spark, reports, output, "2000-03-01", "2000-04-01", upsert=True, model="second")
        columns = ("accession_number", "formatted_text", "year_month", "model")
        return kept(data, data.spark.read.table(output).select(*columns))


def _answers(text: str) -> list[dict]:
    """An extractor that fails on some texts and answers with wrong types on others."""
    kind = len(text) % 7
    if kind == 0:
        raise ValueError(f"{len(text)} characters")
    found = {"extraction_text": text, "extraction_class": "findings_suffix"}
    if kind == 1:
        found["attributes"] = {"section": len(text)}
    if kind == 2:
        found["char_interval"] = {"start_pos": "a", "end_pos": None}
    if kind == 3:
        found["char_interval"] = {"start_pos": "0", "end_pos": len(text)}
    return [found]


@query(
    "failed_extractions",
    rf"""select doc_id, case length(text) % 7 when 0 then length(text) || ' characters'
             when 1 then 'attribute section is not text: ' || length(text) end as error,
           case length(text) % 7 when 0 then 'Error processing report: ' || error
             when 1 then 'Error processing report: ' || error
             else 'IMPRESSION:' || chr(10) || chr(10) || {RSTRIP.format(STRIP.format('text'))} end as formatted_text,
           case when length(text) % 7 = 3 then '0-' || length(text) else '' end as intervals
         from documents""",
)
def _(data: Data) -> DataFrame:
    whole = extractors.python_extractor(_answers, budget=None)
    found = data.base("documents").withColumn("x", whole(F.col("text"))).select("doc_id", "x.*")
    done = structure.build_response(found.select("doc_id", F.col("ok").alias("extractions"), "error"))
    span = F.get("segments", F.lit(0))["intervals"]
    shown = F.array_join(F.transform(span, lambda i: F.concat_ws("-", i["startPos"].cast("string"), i["endPos"].cast("string"))), ",")
    return done.select("doc_id", "error", "formatted_text", F.coalesce(shown, F.lit("")).alias("intervals"))


@query("all_reports_selected", HEADED + "select doc_id::varchar as accession_number, text as report_text from headed")
def _(data: Data) -> DataFrame:
    return select_reports(as_reports(data))
