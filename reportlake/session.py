"""Session settings the jobs are designed for, and the shared scratch folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Adaptive execution decides join sides and splits skewed partitions from measured
# shuffle sizes; no operator in this package hints a broadcast.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where what follows then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The default stores timestamps without least and greatest value, so no file is skipped.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

LOCAL = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Of Parquet files that may hold texts: prose takes a third less room than by Spark's default.
CODEC = "zstd"


def local_session(cores: str = "*", app: str = "reportlake", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, **LOCAL, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; every executor must be able to reach it."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if not folder:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return folder.rstrip("/")


class Staging:
    """Writes intermediate results once, as Parquet, below the shared folder.

    A staged result survives the loss of executors, cuts the lineage, and its file
    size is known to the optimizer when it is joined afterwards.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/reportlake-{uuid.uuid4().hex}"
        self.kept = False
        self.schemas: dict[str, StructType] = {}

    def write(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """``folders``: columns whose values get a folder each."""
        path = f"{self.root}/{name}"
        df.write.mode("error").option("compression", CODEC).partitionBy(*folders).parquet(path)
        self.schemas[name] = df.schema
        return self.read(name, df.schema)

    def read_back(self, name: str) -> DataFrame:
        """What was written under the name."""
        return self.read(name, self.schemas[name])

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def size_in_bytes(self, name: str) -> int:
        path = self._path(name)
        return path.getFileSystem(self._conf()).getContentSummary(path).getLength()

    def small_enough(self, name: str, share: float = 1.0) -> bool:
        """Whether Spark would broadcast a staged result, or a share of its rows, by its size on disk."""
        limit = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return self.size_in_bytes(name) * share <= limit

    def swap(self, name: str, location: str) -> bool:
        """Moves the folders of a staged result into a table's; those in their places go to this area.

        False, and nothing is moved, where the two lie in different stores.
        """
        staged, table, replaced = self._path(name), self._hadoop_path(location), self._path(f"{name}-replaced")
        store = staged.getFileSystem(self._conf())
        if store.getUri().toString() != table.getFileSystem(self._conf()).getUri().toString():
            return False

        def move(one, to) -> None:
            if not store.rename(one, to):
                raise OSError(f"{one} can't be moved to {to}")

        store.mkdirs(replaced)
        for found in store.listStatus(staged):
            if found.isDirectory():
                folder = found.getPath()
                place = self._hadoop_path(table, folder.getName())
                if store.exists(place):
                    move(place, self._hadoop_path(replaced, folder.getName()))
                move(folder, place)
        return True

    def keep(self) -> None:
        """Leave the folder in place when the block ends."""
        self.kept = True

    def drop(self) -> None:
        if self.kept:
            return
        path = self._path()
        path.getFileSystem(self._conf()).delete(path, True)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str | None = None):
        return self._hadoop_path(self.root if name is None else f"{self.root}/{name}")

    def _hadoop_path(self, *parts):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*parts)


@contextmanager
def staging(spark: SparkSession):
    area = Staging(spark)
    try:
        yield area
    finally:
        area.drop()
