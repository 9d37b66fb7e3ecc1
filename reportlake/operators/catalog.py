"""Catalogue maintenance: each change takes the tables and gives the changed table.

Modalities and descriptions are the named entries; procedures refer to them by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.scalars import matches_search, strip
from reportlake.operators.slots import descriptions_in_order, pad_slots, slot_rows
from reportlake.schemas import SLOT_COLUMNS, SLOT_NAMES


@dataclass(frozen=True)
class Named:
    """A dimension of names: its id and name columns."""

    id: str
    name: str
    upper: bool = False

    def clean(self, value: Column) -> Column:
        stripped = strip(value)
        return F.upper(stripped) if self.upper else stripped


MODALITY = Named("modality_id", "modality_name", upper=True)
DESCRIPTION = Named("description_id", "description")

# Ids of new entries are counted per hash bucket, so numbering needs no global sort.
ID_BUCKET_DIGITS = 2


def active_only(table: DataFrame, only: bool = True) -> DataFrame:
    return table.filter("active") if only else table


def list_named(table: DataFrame, dim: Named, only_active: bool = True) -> DataFrame:
    return active_only(table, only_active).orderBy(dim.name, dim.id)


def pick_list(table: DataFrame, dim: Named) -> DataFrame:
    """Id and name of the active entries, by name."""
    return table.filter("active").select(dim.id, dim.name).orderBy(dim.name, dim.id)


def name_options(table: DataFrame, dim: Named) -> DataFrame:
    """Sorted distinct active names, for the filter boxes."""
    return table.filter("active").select(dim.name).distinct().orderBy(dim.name)


def search_named(table: DataFrame, dim: Named, pattern: str, literal: bool = False) -> DataFrame:
    return table.filter(matches_search(dim.name, pattern, literal))


def with_modality(procedures: DataFrame, modalities: DataFrame) -> DataFrame:
    return procedures.join(modalities.select("modality_id", "modality_name"), "modality_id")


def with_description_names(procedures: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Seven left joins, one per slot; each side's size decides how it is joined."""
    out = procedures
    for slot, name in zip(SLOT_COLUMNS, SLOT_NAMES):
        lookup = descriptions.select(
            F.col("description_id").alias(slot), F.col("description").alias(name)
        )
        out = out.join(lookup, slot, "left")
    return out


def list_procedures(
    procedures: DataFrame,
    modalities: DataFrame,
    descriptions: DataFrame,
    only_active: bool = True,
    modality_id: int | None = None,
) -> DataFrame:
    """Procedures with modality and description names, by name."""
    chosen = active_only(procedures, only_active)
    if modality_id:
        chosen = chosen.filter(F.col("modality_id") == modality_id)
    named = with_description_names(with_modality(chosen, modalities), descriptions)
    return named.select(
        "procedure_code",
        "procedure_name",
        "modality_id",
        "modality_name",
        *SLOT_COLUMNS,
        *SLOT_NAMES,
        "active",
        "created_at",
    ).orderBy("procedure_name", "procedure_code")


def description_lists(listed: DataFrame) -> DataFrame:
    return listed.select(
        "procedure_code", descriptions_in_order(SLOT_NAMES).alias("descriptions")
    )


def id_by_name(table: DataFrame, dim: Named, key: str = "name_key") -> DataFrame:
    """One id per upper-cased name: the lowest, where several entries share it."""
    return table.groupBy(F.upper(dim.name).alias(key)).agg(F.min(dim.id).alias(dim.id))


def id_by_exact_name(table: DataFrame, dim: Named) -> DataFrame:
    return table.groupBy(dim.name).agg(F.min(dim.id).alias(dim.id))


# --- Adding ---------------------------------------------------------------------


def absent_names(table: DataFrame, names: DataFrame, dim: Named) -> DataFrame:
    """The proposed names (column ``dim.name``) no entry equals, ignoring case.

    Names that differ in case only are one name; the lowest spelling is taken.
    """
    proposed = names.groupBy(F.upper(dim.name).alias("__upper")).agg(
        F.min(dim.name).alias(dim.name)
    )
    present = table.select(F.upper(dim.name).alias("__upper"))
    return proposed.join(present, "__upper", "left_anti").select(dim.name)


def assign_ids(table: DataFrame, new_names: DataFrame, dim: Named) -> DataFrame:
    """Ids above the highest used one, without gaps.

    Names are numbered inside hash buckets; a bucket starts where the ones before it
    end. Only the bucket counts (at most 256) are numbered in one place.
    """
    bucket = F.substring(F.md5(dim.name), 1, ID_BUCKET_DIGITS)
    bucketed = new_names.withColumn("__bucket", bucket)
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    highest = table.agg(F.coalesce(F.max(dim.id), F.lit(0)).cast("bigint")).scalar()
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(dim.name))
    return (
        bucketed.withColumn("__inside", inside)
        .join(starts, "__bucket")
        .select((highest + F.col("__start") + F.col("__inside")).alias(dim.id), dim.name)
    )


def add_names(
    table: DataFrame, names: DataFrame, dim: Named, at: Column | None = None
) -> DataFrame:
    """The table with the absent names added as active entries."""
    now = F.current_timestamp() if at is None else at
    added = assign_ids(table, absent_names(table, names, dim), dim).select(
        dim.id,
        dim.name,
        F.lit(True).alias("active"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return table.unionByName(added)


def typed_names(names: DataFrame, dim: Named) -> DataFrame:
    """Names as the entry form cleans them: stripped, not blank, modalities upper-cased."""
    cleaned = names.select(dim.clean(F.col(dim.name)).alias(dim.name))
    return cleaned.filter(F.col(dim.name) != "")


def add_procedures(procedures: DataFrame, new: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds rows (procedure_code, procedure_name, modality_id, description_ids) whose
    code is absent; up to seven description ids, the rest are ignored."""
    now = F.current_timestamp() if at is None else at
    added = (
        new.join(procedures.select("procedure_code"), "procedure_code", "left_anti")
        .select(
            "procedure_code",
            "procedure_name",
            "modality_id",
            *pad_slots(F.col("description_ids")),
            F.lit(True).alias("active"),
            now.alias("created_at"),
            now.alias("updated_at"),
        )
    )
    return procedures.unionByName(added)


# --- Changing and removing ------------------------------------------------------


def _touch(table: DataFrame, hit: Column, changes: dict[str, Column], at: Column | None) -> DataFrame:
    now = F.current_timestamp() if at is None else at
    values = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()}
    values["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return table.withColumns(values)


def rename_entry(
    table: DataFrame, dim: Named, entry_id: int, name: str, at: Column | None = None
) -> DataFrame:
    """New name for one entry; other entries with that name are not looked for."""
    return _touch(table, F.col(dim.id) == entry_id, {dim.name: F.lit(name)}, at)


def set_active(
    table: DataFrame, id_column: str, entry_id: int, active: bool, at: Column | None = None
) -> DataFrame:
    return _touch(table, F.col(id_column) == entry_id, {"active": F.lit(active)}, at)


def delete_descriptions(
    descriptions: DataFrame, procedures: DataFrame, doomed: DataFrame
) -> DataFrame:
    """Removes the descriptions in ``doomed`` that no procedure uses."""
    unused = doomed.select("description_id").join(
        slot_rows(procedures).select("description_id"), "description_id", "left_anti"
    )
    return descriptions.join(unused, "description_id", "left_anti")


def description_usage(procedures: DataFrame) -> DataFrame:
    """How many procedures use each description."""
    return slot_rows(procedures).groupBy("description_id").agg(F.count("*").alias("procedures"))


def replace_description(
    procedures: DataFrame, origin: int, target: int, at: Column | None = None
) -> DataFrame:
    """Origin becomes target in every slot, in one pass; only touched rows get a new
    update time. A procedure that had both ends up with the target twice."""
    if origin == target:
        raise ValueError("origin and target must differ")
    hit = F.coalesce(
        F.array_contains(F.array_compact(F.array(*SLOT_COLUMNS)), F.lit(origin)), F.lit(False)
    )
    changes = {
        c: F.when(F.col(c) == origin, F.lit(target).cast("bigint")).otherwise(F.col(c))
        for c in SLOT_COLUMNS
    }
    return _touch(procedures, hit, changes, at)


def replaced_occurrences(procedures: DataFrame, origin: int) -> DataFrame:
    """Occurrences a replacement changes, over the seven slots."""
    counts: Sequence[Column] = [
        F.count_if(F.coalesce(F.col(c) == origin, F.lit(False))) for c in SLOT_COLUMNS
    ]
    total = counts[0]
    for count in counts[1:]:
        total = total + count
    return procedures.agg(total.alias("occurrences"))


def merge_descriptions(
    descriptions: DataFrame,
    procedures: DataFrame,
    origin: int,
    target: int,
    at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replacement in the procedures, and the origin switched off."""
    return (
        set_active(descriptions, "description_id", origin, False, at),
        replace_description(procedures, origin, target, at),
    )
