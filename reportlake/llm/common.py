"""What the operators of this subpackage share: scratch tables, row identity, folds."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        _own_folder[app] = tempfile.mkdtemp(prefix="llm-")
    return _own_folder[app]


class Area:
    """Intermediate tables of one run, as Parquet in the shared folder.

    A written table cuts the lineage, and a lost executor costs its running tasks only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def row_of(docs: DataFrame) -> Column:
    """Where a row lies in the files it was read from: the same in every later read."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(
        F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")
    )


def with_row(docs: DataFrame, area: Area) -> tuple[DataFrame, str]:
    """``docs`` with a column for the row's identity, also where ids repeat or are null.

    Also gives that column's name. Tables that are not read from files are written to the
    shared folder first.
    """
    name = free_name(docs)
    try:
        return docs.withColumn(name, row_of(docs)), name
    except AnalysisException:
        kept = area.keep(docs)
        return kept.withColumn(name, row_of(kept)), name


def id_and_text(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(
        F.col(name).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")
    )


def free_name(docs: DataFrame, wanted: str = "_row") -> str:
    """A column name that ``docs`` doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def pieces(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """(first row, encoded texts) of an Arrow batch, cut where ``most`` bytes are passed.

    A single longer text is a piece of its own. Null counts as empty.
    """
    held, size, first = [], 0, 0
    for k, value in enumerate(batch.column(column)):
        data = value.as_py()
        data = b"" if data is None else data.encode()
        if held and size + len(data) > most:
            yield first, held
            held, size, first = [], 0, k
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def offsets(lengths) -> np.ndarray:
    """Starts of consecutive stretches, and the end."""
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
