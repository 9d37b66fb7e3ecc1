"""Catalogue maintenance and the catalogue file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query, stamp_sql
from checks.standins import Data, with_standins
from reportlake.functions.scalars import same_ignoring_case
from reportlake.operators import catalog, csv_import
from reportlake.operators.catalog import DESCRIPTION, MODALITY
from reportlake.operators.slots import slot_rows, uses_description
from reportlake.schemas import SLOT_COLUMNS, SLOT_NAMES

NOW = "2001-06-01 00:00:00"
WITH = with_standins("modality", "description", "procedure_cat", "csv_lines")
SLOTS = range(1, 8)
SLOT_LIST = ", ".join(SLOT_COLUMNS)
NAME_LIST = ", ".join(SLOT_NAMES)
TIMES = f"{stamp_sql('created_at')} as created_at, {stamp_sql('updated_at')} as updated_at"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def now():
    return F.lit(NOW).cast("timestamp")


def lines(data: Data) -> DataFrame:
    return data.table("csv_lines")


# --- Lists ----------------------------------------------------------------------

for _dim, _table in ((MODALITY, "modality"), (DESCRIPTION, "description")):
    for _only in (True, False):
        query(
            f"list_{_table}_{'active' if _only else 'all'}",
            WITH
            + f"""select {_dim.id}, {_dim.name}, active, {TIMES} from {_table}
                  where {'active' if _only else 'true'} order by {_dim.name}""",
        )(lambda data, t=_table, d=_dim, o=_only: catalog.list_named(data.table(t), d, o))
    query(
        f"pick_list_{_table}",
        WITH + f"select {_dim.id}, {_dim.name} from {_table} where active order by {_dim.name}",
    )(lambda data, t=_table, d=_dim: catalog.pick_list(data.table(t), d))

_LISTED = f"""select p.procedure_code, p.procedure_name, p.modality_id, m.modality_name,
    {', '.join(f'p.{c}' for c in SLOT_COLUMNS)},
    {', '.join(f'd{i}.description as description_{i}' for i in SLOTS)}, p.active,
    {stamp_sql('p.created_at')} as created_at
  from procedure_cat p join modality m on m.modality_id = p.modality_id
  {' '.join(f'left join description d{i} on d{i}.description_id = p.description_id_{i}'
            for i in SLOTS)}
"""


def listed(data: Data, **options) -> DataFrame:
    c = data.catalogue
    return catalog.list_procedures(c.procedures, c.modalities, c.descriptions, **options)


@query("list_procedures_active", WITH + _LISTED + "where p.active")
def _(data: Data) -> DataFrame:
    return listed(data)


@query("list_procedures_of_modality", WITH + _LISTED + "where p.modality_id = 3")
def _(data: Data) -> DataFrame:
    return listed(data, only_active=False, modality_id=3)


@query(
    "description_lists",
    WITH
    + f"""select procedure_code, array_to_string(list_filter([{NAME_LIST}],
            lambda n: n is not null and n <> ''), '|') as descriptions
          from ({_LISTED} where p.active)""",
)
def _(data: Data) -> DataFrame:
    found = catalog.description_lists(listed(data))
    return found.withColumn("descriptions", F.array_join("descriptions", "|"))


@query(
    "search_descriptions_by_pattern",
    WITH
    + """select description_id, description from description
         where regexp_matches(description, '(?i)^s.*l$|ECO|[gr]ed')""",
)
def _(data: Data) -> DataFrame:
    found = catalog.search_named(data.catalogue.descriptions, DESCRIPTION, "^s.*l$|eco|[gr]ed")
    return found.select("description_id", "description")


@query(
    "search_descriptions_literally",
    WITH
    + """select description_id, description from description
         where contains(lower(description), 'mo')""",
)
def _(data: Data) -> DataFrame:
    found = catalog.search_named(data.catalogue.descriptions, DESCRIPTION, "MO", literal=True)
    return found.select("description_id", "description")


@query(
    "equal_ignoring_case",
    WITH
    + """select distinct m.modality_id, l.modality from csv_lines l
         join modality m on upper(m.modality_name) = upper(l.modality)""",
)
def _(data: Data) -> DataFrame:
    same = same_ignoring_case("modality_name", "modality")
    joined = lines(data).join(data.catalogue.modalities, same)
    return joined.select("modality_id", "modality").distinct()


@query(
    "ids_by_name",
    WITH
    + """select upper(description) as name_key, min(description_id) as description_id
         from description group by 1""",
)
def _(data: Data) -> DataFrame:
    return catalog.id_by_name(data.catalogue.descriptions, DESCRIPTION)


@query(
    "ids_by_exact_name",
    WITH
    + """select l.line_no, min(m.modality_id) as modality_id
         from csv_lines l left join modality m on m.modality_name = l.modality group by 1""",
)
def _(data: Data) -> DataFrame:
    ids = catalog.id_by_exact_name(data.catalogue.modalities, MODALITY)
    return (
        lines(data)
        .withColumnRenamed("modality", "modality_name")
        .join(ids, "modality_name", "left")
        .select("line_no", "modality_id")
    )


@query(
    "procedures_using_description",
    WITH + f"select procedure_code from procedure_cat where 3 in ({SLOT_LIST})",
)
def _(data: Data) -> DataFrame:
    return data.catalogue.procedures.filter(uses_description(3)).select("procedure_code")


@query(
    "slot_rows",
    WITH
    + """select distinct p.procedure_code, d.description_id from procedure_cat p
         join description d on d.description_id in (p.description_id_1, p.description_id_2,
           p.description_id_3, p.description_id_4, p.description_id_5, p.description_id_6,
           p.description_id_7)""",
)
def _(data: Data) -> DataFrame:
    return slot_rows(data.catalogue.procedures)


@query(
    "description_usage",
    WITH
    + f"""select description_id, count(distinct procedure_code) as procedures
          from (select procedure_code, unnest([{SLOT_LIST}]) as description_id from procedure_cat)
          where description_id is not null group by 1""",
)
def _(data: Data) -> DataFrame:
    return catalog.description_usage(data.catalogue.procedures)


# --- Adding ---------------------------------------------------------------------


def _added_sql(table: str, id_column: str, name: str, proposed: str) -> str:
    """Table plus absent names, numbered by hash bucket and name."""
    return f"""select {id_column}, {name}, active, {TIMES} from {table}
      union all
      select (select max({id_column}) from {table})
          + row_number() over (order by substr(md5({name}), 1, 2), {name}) as {id_column},
        {name}, true as active, '{NOW}' as created_at, '{NOW}' as updated_at
      from (select min({name}) as {name} from ({proposed}) group by upper({name}))
      where upper({name}) not in (select upper({name}) from {table})"""


TYPED = "select ' ' || p_name || ' ' as name from part union all select p_brand from part"


def _typed(data: Data, dim) -> DataFrame:
    part = data.table("part")
    names = part.select(
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias(dim.name)
    ).unionByName(part.select(F.col("p_brand").alias(dim.name)))
    return catalog.typed_names(names, dim)


@query(
    "add_modalities",
    WITH
    + _added_sql(
        "modality",
        "modality_id",
        "modality_name",
        f"select upper({STRIP.format('name')}) as modality_name from ({TYPED})",
    ),
)
def _(data: Data) -> DataFrame:
    return catalog.add_names(data.catalogue.modalities, _typed(data, MODALITY), MODALITY, now())


@query(
    "add_descriptions",
    WITH
    + _added_sql(
        "description",
        "description_id",
        "description",
        f"select {STRIP.format('name')} as description from ({TYPED})",
    ),
)
def _(data: Data) -> DataFrame:
    names = _typed(data, DESCRIPTION)
    return catalog.add_names(data.catalogue.descriptions, names, DESCRIPTION, now())


_ALL_PROCEDURES = f"""select procedure_code, procedure_name, modality_id, {SLOT_LIST}, active,
  {TIMES} from procedure_cat"""


@query(
    "add_procedures",
    WITH
    + _ALL_PROCEDURES
    + f""" union all select s_suppkey + 100 as procedure_code, s_name as procedure_name,
        1 + s_nationkey as modality_id, 1 + s_nationkey % 20 as description_id_1,
        nullif(s_suppkey % 3, 0) as description_id_2, 7 as description_id_3,
        case when s_suppkey % 2 = 0 then 8 end as description_id_4,
        case when s_suppkey % 2 = 0 then 9 end as description_id_5,
        case when s_suppkey % 2 = 0 then 10 end as description_id_6,
        case when s_suppkey % 2 = 0 then 11 end as description_id_7,
        true as active, '{NOW}' as created_at, '{NOW}' as updated_at
      from supplier where s_suppkey + 100 not in (select procedure_code from procedure_cat)""",
)
def _(data: Data) -> DataFrame:
    nation = F.col("s_nationkey").cast("bigint")
    short = F.array(nation % 20 + 1, F.col("s_suppkey") % 3, F.lit(7))
    more = F.array(*[F.lit(i) for i in (8, 9, 10, 11, 12, 13)]).cast("array<bigint>")
    ids = F.when(F.col("s_suppkey") % 2 == 0, F.concat(short, more)).otherwise(short)
    new = data.table("supplier").select(
        (F.col("s_suppkey") + 100).alias("procedure_code"),
        F.col("s_name").alias("procedure_name"),
        (nation + 1).alias("modality_id"),
        ids.alias("description_ids"),
    )
    return catalog.add_procedures(data.catalogue.procedures, new, now())


# --- Changing and removing ------------------------------------------------------


def _touched_sql(table: str, hit: str, changed: str) -> str:
    return f"""select * replace ({changed}, {stamp_sql('created_at')} as created_at,
        case when {hit} then '{NOW}' else {stamp_sql('updated_at')} end as updated_at)
      from {table}"""


@query(
    "rename_description",
    WITH
    + _touched_sql(
        "description",
        "description_id = 5",
        "case when description_id = 5 then 'renamed' else description end as description",
    ),
)
def _(data: Data) -> DataFrame:
    return catalog.rename_entry(data.catalogue.descriptions, DESCRIPTION, 5, "renamed", now())


@query(
    "rename_modality",
    WITH
    + _touched_sql(
        "modality",
        "modality_id = 2",
        "case when modality_id = 2 then 'RM' else modality_name end as modality_name",
    ),
)
def _(data: Data) -> DataFrame:
    return catalog.rename_entry(data.catalogue.modalities, MODALITY, 2, "RM", now())


for _table, _id, _entry, _on in (
    ("modality", "modality_id", 8, True),
    ("description", "description_id", 4, False),
    ("procedure_cat", "procedure_code", 17, False),
):
    query(
        f"set_active_{_table}",
        WITH
        + _touched_sql(
            _table,
            f"{_id} = {_entry}",
            f"case when {_id} = {_entry} then {_on} else active end as active",
        ),
    )(lambda data, t=_table, i=_id, e=_entry, on=_on: catalog.set_active(data.table(t), i, e, on, now()))


@query(
    "delete_unused_descriptions",
    WITH
    + f"""select description_id, description, active, {TIMES} from description
          where description <> 'PROMO' and description <> 'blue'
             or description_id in (select unnest([{SLOT_LIST}]) from procedure_cat)""",
)
def _(data: Data) -> DataFrame:
    c = data.catalogue
    doomed = c.descriptions.filter(F.col("description").isin("PROMO", "blue"))
    return catalog.delete_descriptions(c.descriptions, c.procedures, doomed)


@query(
    "delete_descriptions_unused_when_inactive_codes_go",
    WITH
    + f"""select description_id, description, active, {TIMES} from description
          where description_id in (select unnest([{SLOT_LIST}]) from procedure_cat
                                   where procedure_name like 'red%')""",
)
def _(data: Data) -> DataFrame:
    c = data.catalogue
    used = c.procedures.filter(F.col("procedure_name").like("red%"))
    return catalog.delete_descriptions(c.descriptions, used, c.descriptions)


_REPLACED = ", ".join(f"case when {c} = 2 then 3 else {c} end as {c}" for c in SLOT_COLUMNS)


@query("replace_description", WITH + _touched_sql("procedure_cat", f"2 in ({SLOT_LIST})", _REPLACED))
def _(data: Data) -> DataFrame:
    return catalog.replace_description(data.catalogue.procedures, 2, 3, now())


@query(
    "replaced_occurrences",
    WITH
    + f"""select count(*) filter (x = 2) as occurrences
          from (select unnest([{SLOT_LIST}]) as x from procedure_cat)""",
)
def _(data: Data) -> DataFrame:
    return catalog.replaced_occurrences(data.catalogue.procedures, 2)


@query(
    "merged_description_is_off",
    WITH
    + _touched_sql(
        "description",
        "description_id = 2",
        "case when description_id = 2 then false else active end as active",
    ),
)
def _(data: Data) -> DataFrame:
    c = data.catalogue
    return catalog.merge_descriptions(c.descriptions, c.procedures, 2, 3, now())[0]


# --- The catalogue file ---------------------------------------------------------


@query(
    "csv_lines_of_modalities",
    WITH + "select line_no, modality from csv_lines where modality in ('brand#3', 'Brand#4')",
)
def _(data: Data) -> DataFrame:
    return csv_import.of_modalities(lines(data), ["brand#3", "Brand#4"]).select(
        "line_no", "modality"
    )


@query(
    "csv_preview",
    WITH
    + """select line_no, procedure_code, procedure_name, modality from csv_lines
         order by line_no limit 20""",
)
def _(data: Data) -> DataFrame:
    return csv_import.preview(lines(data)).select(
        "line_no", "procedure_code", "procedure_name", "modality"
    )


@query(
    "csv_modalities",
    WITH + "select distinct modality from csv_lines where modality is not null order by 1",
)
def _(data: Data) -> DataFrame:
    return csv_import.distinct_modalities(lines(data))


@query(
    "csv_descriptions",
    WITH
    + rf"""select distinct description
           from (select unnest([{NAME_LIST}]) as description from csv_lines)
           where regexp_matches(description, '\S') order by 1""",
)
def _(data: Data) -> DataFrame:
    return csv_import.distinct_descriptions(lines(data))


@query(
    "csv_summary",
    WITH
    + rf"""select count(*) as lines, count(distinct modality) as modalities,
             (select count(distinct d) from (select unnest([{NAME_LIST}]) as d from csv_lines)
              where regexp_matches(d, '\S')) as descriptions from csv_lines""",
)
def _(data: Data) -> DataFrame:
    return csv_import.file_summary(lines(data))


@query(
    "csv_duplicated_lines",
    WITH
    + """select line_no, procedure_code, procedure_name, modality from csv_lines
         qualify count(*) over (partition by procedure_code) > 1""",
)
def _(data: Data) -> DataFrame:
    return csv_import.duplicated_lines(lines(data)).select(
        "line_no", "procedure_code", "procedure_name", "modality"
    )


@query(
    "csv_duplicated_codes",
    WITH
    + """select procedure_code, arg_min(procedure_name, line_no) as procedure_name,
           arg_min(modality, line_no) filter (modality is not null) as modality,
           count(*) as lines
         from csv_lines where procedure_code is not null group by 1 having count(*) > 1""",
)
def _(data: Data) -> DataFrame:
    return csv_import.duplicated_codes(lines(data))


@query(
    "catalogue_counts",
    WITH
    + """select (select count(*) from modality) as modalities,
           (select count(*) from description) as descriptions,
           (select count(*) from procedure_cat) as procedures""",
)
def _(data: Data) -> DataFrame:
    c = data.catalogue
    return csv_import.catalogue_counts(c.modalities, c.descriptions, c.procedures)


@query(
    "same_name_procedures",
    WITH
    + """select procedure_name, count(*) over (partition by procedure_name) as n, procedure_code
         from procedure_cat qualify n > 1""",
)
def _(data: Data) -> DataFrame:
    return csv_import.same_name_procedures(data.catalogue.procedures)


_PROPOSED_MODALITIES = """select modality as modality_name from csv_lines
  where modality is not null"""
_PROPOSED_DESCRIPTIONS = rf"""select {STRIP.format('x')} as description
  from (select unnest([{NAME_LIST}]) as x from csv_lines) where regexp_matches(x, '\S')"""


@query(
    "import_modalities",
    WITH + _added_sql("modality", "modality_id", "modality_name", _PROPOSED_MODALITIES),
)
def _(data: Data) -> DataFrame:
    return csv_import.import_names(data.catalogue.modalities, lines(data), MODALITY, now())


@query(
    "import_descriptions",
    WITH + _added_sql("description", "description_id", "description", _PROPOSED_DESCRIPTIONS),
)
def _(data: Data) -> DataFrame:
    return csv_import.import_names(data.catalogue.descriptions, lines(data), DESCRIPTION, now())


def _name_counts(table: str, name: str, proposed: str) -> str:
    return f"""select added, everything - added as rejected from (select
        (select count(distinct upper({name})) from ({proposed})
         where upper({name}) not in (select upper({name}) from {table})) as added,
        (select count(distinct {name}) from ({proposed})) as everything)"""


@query(
    "import_modalities_counts",
    WITH + _name_counts("modality", "modality_name", _PROPOSED_MODALITIES),
)
def _(data: Data) -> DataFrame:
    return csv_import.import_names_counts(data.catalogue.modalities, lines(data), MODALITY)


@query(
    "import_descriptions_counts",
    WITH + _name_counts("description", "description", _PROPOSED_DESCRIPTIONS),
)
def _(data: Data) -> DataFrame:
    return csv_import.import_names_counts(data.catalogue.descriptions, lines(data), DESCRIPTION)


_STATUS = """, resolved as (select l.*, (select min(m.modality_id) from modality m
      where upper(m.modality_name) = upper(l.modality)) as modality_id from csv_lines l),
  classified as (select *,
      case when procedure_code is null then 'error'
        when procedure_code in (select procedure_code from procedure_cat) then 'duplicate'
        when line_no > min(line_no) filter (modality_id is not null)
          over (partition by procedure_code) then 'duplicate'
        when modality_id is not null then 'inserted' else 'error' end as status
    from resolved)
"""


def classified(data: Data) -> DataFrame:
    c = data.catalogue
    return csv_import.classify_lines(lines(data), c.procedures, c.modalities)


@query(
    "csv_line_status",
    WITH + _STATUS + "select line_no, procedure_code, modality_id, status from classified",
)
def _(data: Data) -> DataFrame:
    return classified(data).select("line_no", "procedure_code", "modality_id", "status")


@query(
    "import_procedures_counts",
    WITH
    + _STATUS
    + """select count(*) as lines, count(*) filter (status = 'inserted') as inserted,
           count(*) filter (status = 'error') as unknown_modality,
           count(*) filter (status = 'duplicate') as duplicates,
           count(*) filter (status <> 'inserted') as not_imported from classified""",
)
def _(data: Data) -> DataFrame:
    return csv_import.import_procedures_counts(classified(data))


def _slot_lookup(table: str) -> str:
    return ", ".join(
        f"""(select min(d.description_id) from {table} d
            where upper(d.description) = upper({STRIP.format(f'c.description_{i}')}))
            as description_id_{i}"""
        for i in SLOTS
    )


@query(
    "import_procedures",
    WITH
    + _STATUS
    + _ALL_PROCEDURES
    + f""" union all select c.procedure_code, c.procedure_name, c.modality_id,
        {_slot_lookup('description')}, true as active, '{NOW}' as created_at, '{NOW}' as updated_at
      from classified c where status = 'inserted'""",
)
def _(data: Data) -> DataFrame:
    c = data.catalogue
    return csv_import.import_procedures(
        c.procedures, c.modalities, c.descriptions, lines(data), None, now()
    )


@query(
    "import_catalogue",
    WITH
    + f""", all_modalities as ({_added_sql('modality', 'modality_id', 'modality_name',
                                           _PROPOSED_MODALITIES)}),
      all_descriptions as ({_added_sql('description', 'description_id', 'description',
                                       _PROPOSED_DESCRIPTIONS)})"""
    + _STATUS.replace("from modality m", "from all_modalities m")
    + f"""select c.procedure_code, c.procedure_name, c.modality_id,
        {_slot_lookup('all_descriptions')}
      from classified c where status = 'inserted'
      union all select procedure_code, procedure_name, modality_id, {SLOT_LIST}
      from procedure_cat""",
)
def _(data: Data) -> DataFrame:
    c = data.catalogue
    tables = {
        "modalities": c.modalities,
        "descriptions": c.descriptions,
        "procedures": c.procedures,
    }
    grown = csv_import.import_catalogue(tables, lines(data), now())
    return grown["procedures"].drop("active", "created_at", "updated_at")
