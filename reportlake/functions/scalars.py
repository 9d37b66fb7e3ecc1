"""Scalar expressions shared by the extraction, the catalogue and the queries."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Whitespace as a regular-expression class (with (?U)) and as the characters themselves.
BLANKS = r"\s\x1c-\x1f"
BLANK_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Day names by day-of-week number, 1 = Sunday.
WEEKDAYS = ("Domingo", "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado")

LABEL_CHARS = 50

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day(value: date | str | Column) -> Column:
    """A date given as a date, an ISO string (checked now) or a column."""
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(parse_day(value))


def parse_day(value: date | str) -> date:
    if isinstance(value, date):
        return value
    return datetime.strptime(value, "%Y-%m-%d").date()


def accession_key(*parts: ColumnOrName, separator: str = "") -> Column:
    """The key parts as text, one after the other; a null part counts as empty."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(separator, *texts)


def year_month(value: ColumnOrName) -> Column:
    return F.date_format(_col(value), "yyyy-MM")


def lenient_number(value: ColumnOrName) -> Column:
    """Text to double; null and anything that is not a plain number become 0."""
    text = _col(value).cast("string")
    parsed = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.coalesce(parsed, F.lit(0.0))


def day_plus_seconds(day_column: ColumnOrName, seconds: ColumnOrName) -> Column:
    """Wall-clock timestamp; 86400 seconds or more run on into the next day."""
    span = F.coalesce(lenient_number(seconds).try_cast("decimal(18,6)"), F.lit(0))
    midnight = _col(day_column).cast("date").cast("timestamp_ntz")
    return (midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), span)).cast("timestamp")


def weekday_name(day_number: Column) -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return F.get(names, day_number - 1)


def non_blank(text: ColumnOrName) -> Column:
    return F.coalesce(lstrip(text) != "", F.lit(False))


def strip(text: ColumnOrName) -> Column:
    return F.btrim(_col(text), F.lit(BLANK_CHARS))


def lstrip(text: ColumnOrName) -> Column:
    return F.ltrim(_col(text), F.lit(BLANK_CHARS))


def rstrip(text: ColumnOrName) -> Column:
    return F.rtrim(_col(text), F.lit(BLANK_CHARS))


def short_label(text: ColumnOrName, chars: int = LABEL_CHARS) -> Column:
    """The first characters followed by an ellipsis, which is always there."""
    return F.concat(F.substring(_col(text), 1, chars), F.lit("..."))


def same_ignoring_case(left: ColumnOrName, right: ColumnOrName) -> Column:
    return F.upper(_col(left)) == F.upper(_col(right))


def matches_search(text: ColumnOrName, pattern: str, literal: bool = False) -> Column:
    """Search box: a case-insensitive regular expression anywhere in the text."""
    if literal:
        found = F.contains(F.lower(_col(text)), F.lower(F.lit(pattern)))
    else:
        found = _col(text).rlike(f"(?iu){pattern}")
    return F.coalesce(found, F.lit(False))


def display_time(value: ColumnOrName) -> Column:
    return F.date_format(F.to_timestamp(_col(value)), "dd/MM/yyyy HH:mm")


def share(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, as a double."""
    return F.round(part.cast("double") * 100.0 / whole, 2)


def to_json_keeping_nulls(value: ColumnOrName) -> Column:
    return F.to_json(_col(value), {"ignoreNullFields": "false"})


def empty_to_null(value: ColumnOrName) -> Column:
    """Empty array or map to null, so that JSON output leaves the field out."""
    return F.when(F.size(_col(value)) > 0, _col(value))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Without this, an expression mentioned inside a lambda is computed again for
    every element the lambda visits.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
