"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last
return the columns of ``docs``; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportlake.llm.common import Area, table
from reportlake.llm.decontaminate import drop_contaminated
from reportlake.llm.dedup import drop_copies
from reportlake.llm.near import drop_near_copies
from reportlake.llm.packing import pack_documents
from reportlake.llm.quality import keep_good

# Words in a generation of the tokenizer's cache: the workers also hold what earlier stages left.
WORDS_KEPT = 50_000

# Some stages are models or evolve their result, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go; it learns from labels of ``docs``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays.

    Linked are fingerprints as op3 links them, and sets of five-word shingles of similarity 0.8.
    """
    return drop_near_copies(docs, fingerprints=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence."""
    return pack_documents(docs, kept=WORDS_KEPT)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", benchmark),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each result written before the next reads it."""
    area = Area(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = area.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
