"""The seven description columns of a procedure, seen as rows or as an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.schemas import SLOT_COLUMNS, SLOTS


def slot_array(columns: Sequence[str] = SLOT_COLUMNS) -> Column:
    return F.array(*[F.col(c) for c in columns])


def slot_rows(procedures: DataFrame) -> DataFrame:
    """One row per procedure and distinct description; nothing for empty slots.

    Joining on this is an equi join, where ``id IN (slot1, ..., slot7)`` would be a
    nested loop.
    """
    used = F.array_distinct(F.array_compact(slot_array()))
    return procedures.select("procedure_code", F.explode(used).alias("description_id"))


def uses_description(description_id: Column | int) -> Column:
    """True when any of the seven slots holds the description."""
    wanted = description_id if isinstance(description_id, Column) else F.lit(description_id)
    return F.coalesce(F.array_contains(F.array_compact(slot_array()), wanted), F.lit(False))


def pad_slots(ids: Column) -> list[Column]:
    """Up to seven ids into the seven columns: short lists end in null, 0 is null."""
    return [
        F.nullif(F.get(ids, F.lit(i)), F.lit(0)).cast("bigint").alias(SLOT_COLUMNS[i])
        for i in range(SLOTS)
    ]


def descriptions_in_order(names: Sequence[str]) -> Column:
    """The non-empty names of a procedure as a list, in slot order."""
    return F.filter(F.array(*[F.col(n) for n in names]), lambda n: n.isNotNull() & (n != ""))
