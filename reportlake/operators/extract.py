"""From the source systems' tables to one clean, deduplicated batch of reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.scalars import (
    accession_key,
    all_of,
    day,
    day_plus_seconds,
    non_blank,
    parse_day,
    year_month,
)
from reportlake.schemas import REPORT_KEY, REPORTS, RUN_DAILY

TEXT_HASH = "text_hash"

# Which of several rows with one accession number is kept: the lowest of these.
TIE_BREAK = (
    "source",
    "encounter_id",
    "occurrence_no",
    "order_no",
    "procedure_code",
    "patient_id",
    "performed_at",
)


def processing_window(
    mode: str, day_to_process: date | str | None = None, back_days: int = 1, today: date | None = None
) -> tuple[date, date]:
    """Half-open window: that day for a daily run, N days more for a reprocess."""
    if day_to_process:
        end_day = parse_day(day_to_process)
    else:
        end_day = (today or date.today()) - timedelta(days=1)
    first = end_day if mode == RUN_DAILY else end_day - timedelta(days=back_days)
    return first, end_day + timedelta(days=1)


def union_systems(tables: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of one table of every system, tagged with the system it came from."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in tables.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def active_procedures(procedures: DataFrame, modalities: DataFrame) -> DataFrame:
    """Active procedures with their modality, by code."""
    return (
        procedures.filter("active")
        .join(modalities.select("modality_id", "modality_name"), "modality_id")
        .select("procedure_code", "procedure_name", "modality_name")
        .orderBy("procedure_code")
    )


def active_codes(procedures: DataFrame) -> DataFrame:
    return procedures.filter("active").select("procedure_code")


def in_window(column: str, start: date | str | Column | None, end: date | str | Column | None) -> Column:
    """Half-open range; either end may be open."""
    bounds = []
    if start is not None:
        bounds.append(F.col(column) >= day(start))
    if end is not None:
        bounds.append(F.col(column) < day(end))
    return all_of(bounds)


def performed_in_window(
    performed: DataFrame,
    codes: DataFrame | None,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """Performed procedures with an active code inside the window."""
    out = performed
    if start is not None or end is not None:
        out = out.filter(in_window("performed_date", start, end))
    if codes is not None:
        out = out.join(codes, "procedure_code", "left_semi")
    return out


def attach_patients(
    performed: DataFrame, encounters: DataFrame, strict_source: bool = False
) -> DataFrame:
    """One row per system that knows the encounter, or only the procedure's own system."""
    if strict_source:
        return performed.join(encounters, ["encounter_id", "source"])
    return performed.drop("source").join(encounters, "encounter_id")


def usable_texts(reports: DataFrame, of_text: Mapping[str, Column] | None = None) -> DataFrame:
    """Reports with a text, its hash and the columns in ``of_text``, all taken where it is read.

    The hash chooses among texts, so an empty ``of_text`` goes without.
    """
    texts = reports.filter(non_blank("report_text"))
    if of_text is not None and not of_text:
        return texts
    return texts.withColumns({TEXT_HASH: F.xxhash64("report_text"), **(of_text or {})})


def attach_texts(with_patient: DataFrame, reports: DataFrame, hash_below: bool = True) -> DataFrame:
    """The usable report texts of the rows.

    The text's hash is taken below the join, so consumers of other columns never move
    the text itself. Jobs that load the text take it above: then only texts of the rows
    are hashed, not all there are.
    """
    keys = ["encounter_id", "occurrence_no", "order_no", "source"]
    if hash_below:
        return with_patient.join(usable_texts(reports), keys)
    texts = reports.filter(non_blank("report_text"))
    return with_patient.join(texts, keys).withColumn(TEXT_HASH, F.xxhash64("report_text"))


def attach_reports(
    performed: DataFrame,
    encounters: DataFrame,
    reports: DataFrame,
    strict_source: bool = False,
    of_text: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Join patients and report texts onto performed procedures.

    A row takes the source of the report it matched. By default a procedure may match
    reports of both systems; ``strict_source`` keeps it within its own. The patients come
    first, so that the report texts go through one shuffle here and no more.

    ``of_text`` are columns made of the text where it is read, such as a digest, or none, for
    who has no use for the text itself: without it a report is a narrow row, which meets the
    patient its system knows first. A procedure is then moved once and not once a system.
    """
    if of_text is None:
        return attach_texts(attach_patients(performed, encounters, strict_source), reports)
    known = usable_texts(reports, of_text).join(encounters, ["encounter_id", "source"])
    keys = ["encounter_id", "occurrence_no", "order_no"]
    if strict_source:
        return performed.join(known, [*keys, "source"])
    return performed.drop("source").join(known, keys)


def choose_reports(with_patient: DataFrame, reports: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The rows that stay, one per accession number and value of ``also``, without their texts.

    Only the hash of a text leaves the scan; it stays with the row, for ``fetch_texts``.
    """
    keys = attach_texts(with_patient, reports)
    return one_per_accession(to_report_rows(keys, also=also, text=False), also, keep_hash=True)


def fetch_texts(chosen: DataFrame, reports: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The texts of chosen rows: one shuffle of texts, or none if the rows are few enough to be sent.

    Of equal texts under one key one is taken; the join has gathered them already.
    """
    keys = ["encounter_id", "occurrence_no", "order_no", "source", TEXT_HASH]
    return chosen.join(usable_texts(reports), keys).dropDuplicates([*keys, REPORT_KEY, *also]).drop(TEXT_HASH)


def to_report_rows(
    joined: DataFrame, strict_key: bool = False, also: Sequence[str] = (), text: bool = True
) -> DataFrame:
    """Key, timestamp and partition month; helper columns go, but for those in ``also``.

    ``text`` False leaves the report text out.
    """
    separator = "-" if strict_key else ""
    return joined.select(
        "encounter_id",
        "occurrence_no",
        "order_no",
        accession_key("encounter_id", "occurrence_no", "order_no", separator=separator).alias(
            REPORT_KEY
        ),
        "procedure_code",
        "patient_id",
        *(["report_text"] if text else []),
        day_plus_seconds("performed_date", "performed_seconds").alias("performed_at"),
        "source",
        year_month("performed_date").alias("year_month"),
        *([TEXT_HASH] if TEXT_HASH in joined.columns else []),
        *also,
    )


def one_per_accession(rows: DataFrame, also: Sequence[str] = (), keep_hash: bool = False) -> DataFrame:
    """One row per accession number (and value of ``also``), always the same one.

    ``row_number() = 1`` is reduced before the shuffle (a partial group limit), so an
    accession number holding a large part of the rows sends one row per input task. Rows that
    differ in their texts alone are told apart by the texts' hash, if they have one.
    """
    order = [F.col(c).asc_nulls_first() for c in (*TIE_BREAK, TEXT_HASH) if c in rows.columns]
    ranked = Window.partitionBy(REPORT_KEY, *also).orderBy(*order)
    kept = rows.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") == 1)
    return kept.drop("__rank", *([] if keep_hash else [TEXT_HASH]))


def stamp(
    rows: DataFrame, run_mode: str, loaded_at: Column | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """Load time and run mode, in the column order of the table; other columns go, but for ``also``."""
    stamped = rows.withColumns(
        {
            "loaded_at": F.current_timestamp() if loaded_at is None else loaded_at,
            "run_mode": F.lit(run_mode),
        }
    )
    return stamped.select(*[c for c in REPORTS.fieldNames() if c in stamped.columns], *also)


def extract_reports(
    performed: DataFrame,
    encounters: DataFrame,
    reports: DataFrame,
    codes: DataFrame | None,
    start: date | str | None = None,
    end: date | str | None = None,
    strict_source: bool = False,
    strict_key: bool = False,
    of_text: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Window and code filter, joins, projection: every row before deduplication.

    ``of_text``: columns made of the text, for who has no use for it (see ``attach_reports``).
    """
    windowed = performed_in_window(performed, codes, start, end)
    joined = attach_reports(windowed, encounters, reports, strict_source, of_text)
    return to_report_rows(joined, strict_key, also=[name for name in of_text or () if name != TEXT_HASH])


def key_collisions(rows: DataFrame) -> DataFrame:
    """Accession numbers shared by different (encounter, occurrence, order) triples."""
    triples = rows.select(REPORT_KEY, "encounter_id", "occurrence_no", "order_no").distinct()
    return triples.groupBy(REPORT_KEY).agg(F.count("*").alias("triples")).filter("triples > 1")
