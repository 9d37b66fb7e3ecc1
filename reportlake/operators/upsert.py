"""Keyed merges as queries: what the table holds after the batch is applied.

``source`` must hold each key once, which ``one_per_accession`` guarantees.

Two equal shapes: the full outer join reads both sides once and suits a large batch.
The lookup shape leaves target rows where they are when the batch is small enough to
be sent to them, so a daily batch does not shuffle the texts of whole months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.schemas import REPORT_KEY

# Columns a daily run refreshes on a row that is there already.
DAILY_COLUMNS = ("report_text", "loaded_at")

_HIT = "__hit"


def _incoming(source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    renamed = [F.col(c).alias(f"__new_{c}") for c in columns]
    return source.select(F.col(key), *renamed, F.lit(True).alias(_HIT))


def _pick(target: DataFrame, key: str, updated: Sequence[str], inserted: bool) -> list:
    """Matched rows take the incoming value even where it is null."""
    picked = []
    for name in target.columns:
        old, new = F.col(name), F.col(f"__new_{name}")
        if name == key:
            value = old
        elif name in updated:
            value = F.when(F.col(_HIT), new).otherwise(old)
        elif inserted:
            value = F.when(F.col("__old").isNull(), new).otherwise(old)
        else:
            value = old
        picked.append(value.alias(name))
    return picked


def merge_full(target: DataFrame, source: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    incoming = _incoming(source, key, [c for c in target.columns if c != key])
    joined = target.withColumn("__old", F.lit(True)).join(incoming, key, "full_outer")
    return joined.select(*_pick(target, key, updated, inserted=True))


def merge_by_lookup(
    target: DataFrame, source: DataFrame, key: str, updated: Sequence[str]
) -> DataFrame:
    incoming = _incoming(source, key, [c for c in updated if c != key])
    kept = target.join(incoming, key, "left").select(*_pick(target, key, updated, inserted=False))
    inserts = source.join(target.select(key), key, "left_anti").select(*target.columns)
    return kept.unionByName(inserts)


def _shape(small_source: bool):
    return merge_by_lookup if small_source else merge_full


def merge_daily(
    target: DataFrame,
    source: DataFrame,
    key: str = REPORT_KEY,
    small_source: bool = False,
    of_text: Sequence[str] = (),
) -> DataFrame:
    """Daily rule: a match refreshes text and load time, anything else is inserted.

    ``of_text``: columns made of the text, such as its digest, which go with it.
    """
    return _shape(small_source)(target, source, key, (*DAILY_COLUMNS, *of_text))


def merge_all(
    target: DataFrame, source: DataFrame, key: str = REPORT_KEY, small_source: bool = False
) -> DataFrame:
    """Reprocess rule: a match takes every column of the batch, nulls included."""
    return _shape(small_source)(target, source, key, target.columns)

