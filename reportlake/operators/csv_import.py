"""The catalogue file: reading, looking into it, importing it.

Lines carry ``line_no``, an order of appearance that is known without numbering the
file in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions.scalars import non_blank, strip
from reportlake.operators.catalog import (
    DESCRIPTION,
    MODALITY,
    Named,
    absent_names,
    add_names,
    id_by_name,
)
from reportlake.schemas import CSV_COLUMNS, CSV_HEADERS, SLOT_COLUMNS, SLOT_NAMES

INSERTED, DUPLICATE, ERROR = "inserted", "duplicate", "error"

_FILE_SCHEMA = T.StructType(
    [
        T.StructField(h, T.LongType() if h == CSV_HEADERS[0] else T.StringType())
        for h in CSV_HEADERS
    ]
)


def read_catalogue_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The ``;``-separated UTF-8 file; a missing column rejects it as a whole."""
    reader = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8")
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    header = reader.csv(path).columns
    missing = [h for h in CSV_HEADERS if h not in header]
    if missing:
        raise ValueError(f"missing columns in {path}: {missing}")
    kinds = {f.name: f.dataType for f in _FILE_SCHEMA.fields}
    schema = T.StructType([T.StructField(h, kinds.get(h, T.StringType())) for h in header])
    lines = reader.schema(schema).csv(path)
    return lines.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_no"),
        *[F.col(h).alias(c) for h, c in zip(CSV_HEADERS, CSV_COLUMNS)],
    )


def of_modalities(lines: DataFrame, modalities: Sequence[str] | None) -> DataFrame:
    """Only the lines of the chosen modalities; no choice keeps all."""
    return lines.filter(F.col("modality").isin(list(modalities))) if modalities else lines


def preview(lines: DataFrame, k: int = 20) -> DataFrame:
    """The first lines of the file."""
    return lines.orderBy("line_no").limit(k)


def distinct_modalities(lines: DataFrame) -> DataFrame:
    return (
        lines.select("modality").filter(F.col("modality").isNotNull()).distinct().orderBy("modality")
    )


def distinct_descriptions(lines: DataFrame) -> DataFrame:
    """Non-blank values over the seven columns."""
    values = lines.select(F.explode(F.array(*SLOT_NAMES)).alias("description"))
    return values.filter(non_blank("description")).distinct().orderBy("description")


def duplicated_lines(lines: DataFrame) -> DataFrame:
    """Every line of a code that appears more than once, and lines without a code if
    there are several.

    The repeated codes are counted with partial aggregates and joined back, so a code
    on a large part of the lines is not gathered anywhere.
    """
    repeated = (
        lines.groupBy("procedure_code")
        .agg(F.count("*").alias("__n"))
        .filter("__n > 1")
        .select("procedure_code")
    )
    same = lines["procedure_code"].eqNullSafe(repeated["procedure_code"])
    return lines.join(repeated, same, "left_semi")


def _first(column: str) -> Column:
    """Value on the first line that has one."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("line_no"))).alias(column)


def duplicated_codes(lines: DataFrame) -> DataFrame:
    """Repeated codes with their first name and modality and how often they appear."""
    return (
        lines.groupBy("procedure_code")
        .agg(_first("procedure_name"), _first("modality"), F.count("*").alias("lines"))
        .filter((F.col("lines") > 1) & F.col("procedure_code").isNotNull())
        .orderBy(F.desc("lines"), "procedure_code")
    )


def file_summary(lines: DataFrame) -> DataFrame:
    """Lines, distinct modalities and distinct descriptions of the file, in one pass each."""
    descriptions = distinct_descriptions(lines).agg(F.count("*")).scalar()
    return lines.agg(
        F.count("*").alias("lines"), F.countDistinct("modality").alias("modalities")
    ).select("lines", "modalities", descriptions.alias("descriptions"))


# --- Import ---------------------------------------------------------------------


def _proposed(lines: DataFrame, dim: Named) -> DataFrame:
    if dim is MODALITY:
        return distinct_modalities(lines).select(F.col("modality").alias(dim.name))
    return distinct_descriptions(lines).select(strip("description").alias(dim.name)).distinct()


def import_names(
    table: DataFrame, lines: DataFrame, dim: Named, at: Column | None = None
) -> DataFrame:
    """The dimension with the file's new names added."""
    return add_names(table, _proposed(lines, dim), dim, at)


def import_names_counts(table: DataFrame, lines: DataFrame, dim: Named) -> DataFrame:
    """Names added and names rejected because they are there already."""
    proposed = _proposed(lines, dim)
    added = absent_names(table, proposed, dim).agg(F.count("*")).scalar()
    return proposed.agg(F.count("*").alias("__all")).select(
        added.alias("added"), (F.col("__all") - added).alias("rejected")
    )


def _resolve_descriptions(lines: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Description texts to ids; an unknown or blank text becomes an empty slot.

    The filled slots become rows and meet the ids in one join; empty slots, which are most,
    take no part in it.
    """
    ids = id_by_name(descriptions, DESCRIPTION)
    texts = F.posexplode(F.array(*SLOT_NAMES)).alias("__slot", "__text")
    filled = lines.select("line_no", texts).filter(non_blank("__text"))
    named = filled.select("line_no", "__slot", F.upper(strip("__text")).alias("name_key"))
    slots = [
        F.max(F.when(F.col("__slot") == i, F.col("description_id"))).alias(slot)
        for i, slot in enumerate(SLOT_COLUMNS)
    ]
    found = named.join(ids, "name_key").groupBy("line_no").agg(*slots)
    return lines.join(found, "line_no", "left")


def classify_lines(lines: DataFrame, procedures: DataFrame, modalities: DataFrame) -> DataFrame:
    """Each line as inserted, duplicate or error, with its modality id.

    A code that is in the table is a duplicate. Among the rest the first line whose
    modality is known is inserted and the lines after it are duplicates; a line with an
    unknown modality before that is an error, and so is one whose code is no number.
    """
    known = id_by_name(modalities, MODALITY)
    resolved = (
        lines.withColumn("name_key", F.upper("modality")).join(known, "name_key", "left")
    ).drop("name_key")
    # One small row a code, and one join of the lines with it, which adaptive execution can
    # split where a code is on many lines. Lines without a code stay out of it.
    present = procedures.select("procedure_code", F.lit(True).alias("__present"))
    facts = (
        resolved.filter(F.col("procedure_code").isNotNull())
        .select(
            "procedure_code",
            F.lit(False).alias("__present"),
            F.when(F.col("modality_id").isNotNull(), F.col("line_no")).alias("__line"),
        )
        .unionByName(present, allowMissingColumns=True)
        .groupBy("procedure_code")
        .agg(F.max("__present").alias("__present"), F.min("__line").alias("__first"))
    )
    placed = resolved.join(facts, "procedure_code", "left")
    status = (
        F.when(F.col("procedure_code").isNull(), ERROR)
        .when(F.col("__present"), DUPLICATE)
        .when(F.col("line_no") == F.col("__first"), INSERTED)
        .when(F.col("line_no") > F.col("__first"), DUPLICATE)
        .otherwise(ERROR)
    )
    return placed.withColumn("status", status).drop("__present", "__first")


def import_procedures(
    procedures: DataFrame,
    modalities: DataFrame,
    descriptions: DataFrame,
    lines: DataFrame,
    chosen: Sequence[str] | None = None,
    at: Column | None = None,
) -> DataFrame:
    """The procedures with the file's insertable lines added."""
    now = F.current_timestamp() if at is None else at
    classified = classify_lines(of_modalities(lines, chosen), procedures, modalities)
    fresh = classified.filter(F.col("status") == INSERTED)
    added = _resolve_descriptions(fresh, descriptions).select(
        "procedure_code",
        "procedure_name",
        "modality_id",
        *SLOT_COLUMNS,
        F.lit(True).alias("active"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return procedures.unionByName(added)


def import_procedures_counts(classified: DataFrame) -> DataFrame:
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return classified.agg(
        F.count("*").alias("lines"),
        count(INSERTED).alias("inserted"),
        count(ERROR).alias("unknown_modality"),
        count(DUPLICATE).alias("duplicates"),
        (count(ERROR) + count(DUPLICATE)).alias("not_imported"),
    )


def catalogue_counts(
    modalities: DataFrame, descriptions: DataFrame, procedures: DataFrame
) -> DataFrame:
    """Rows of the three tables."""
    return procedures.agg(F.count("*").alias("procedures")).select(
        modalities.agg(F.count("*")).scalar().alias("modalities"),
        descriptions.agg(F.count("*")).scalar().alias("descriptions"),
        "procedures",
    )


def same_name_procedures(procedures: DataFrame) -> DataFrame:
    """Codes whose name other codes carry too, with how many there are: a row a code."""
    counts = procedures.groupBy("procedure_name").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        procedures.select("procedure_name", "procedure_code")
        .join(counts, "procedure_name")
        .select("procedure_name", "n", "procedure_code")
        .orderBy(F.desc("n"), "procedure_name", "procedure_code")
    )


def import_catalogue(
    tables: dict[str, DataFrame], lines: DataFrame, at: Column | None = None
) -> dict[str, DataFrame]:
    """Modalities, descriptions and procedures after importing the whole file.

    The names come first, so the procedures are resolved against the grown tables.
    """
    modalities = import_names(tables["modalities"], lines, MODALITY, at)
    descriptions = import_names(tables["descriptions"], lines, DESCRIPTION, at)
    procedures = import_procedures(tables["procedures"], modalities, descriptions, lines, None, at)
    return {"modalities": modalities, "descriptions": descriptions, "procedures": procedures}
