"""Exact duplicates by a tree merge of sorted digest runs.

Every task sorts its digests into runs, with one entry a digest. Runs lie in numbered
partitions, as many as the session shuffles into, rounded up to a power of four. In a round
the partitions whose numbers differ in the same two bits exchange runs: the entries whose
digest has another value in these bits move to the partition of that value, and what
arrives there is merged four ways, keeping one entry a digest. Each exchange is two rounds
of a binomial tree at once. When every bit has had its round a digest lies in a single
partition. Each merge adds sizes up and keeps the surviving identifier, so a text that
fills a third of the table is down to one entry a run before anything moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm.common import Area, id_and_text, with_row

FAN = 4  # runs that meet in one exchange
LEAF = 200_000  # entries a task sorts at once
TEXT = ["digest", "check", "bytes"]  # entries merge only where all three agree
ENTRIES = "row struct<file bigint, at bigint>, doc_id bigint, digest binary, check bigint, bytes bigint, raw bigint, size bigint"
DIGESTS = "row struct<file bigint, at bigint>, doc_id bigint, digest binary, check bigint, bytes bigint, raw bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, check, size, raw = [], [], [], []
        for value in batch.column("text"):
            data = (value.as_py() or "").encode()
            raw.append(xxhash.xxh64_intdigest(data) - (1 << 63))
            data = data.lower()  # of bytes: A-Z only
            digest.append(hashlib.sha256(data).digest())
            check.append(xxhash.xxh64_intdigest(data) - (1 << 63))
            size.append(len(data))
        whole = [pa.array(digest, pa.binary()), *(pa.array(c, pa.int64()) for c in (check, size, raw))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), *whole], names=["row", "doc_id", "digest", "check", "bytes", "raw"]
        )


def digests(narrow: DataFrame, area: Area) -> DataFrame:
    """Row, id and SHA-256 of the text with A-Z lower-cased, staged."""
    return area.keep(narrow.mapInArrow(_digests, DIGESTS))


def _sorted_run(held: list[pa.RecordBatch], largest: bool) -> pa.RecordBatch:
    """The entries of ``held`` in the order of their texts, one a text."""
    table = pa.Table.from_batches(held).combine_chunks()
    row = table.column("row").combine_chunks()
    known = pc.is_valid if largest else pc.is_null
    keys = pa.table(
        [*(table.column(n) for n in TEXT), pc.cast(known(table.column("doc_id")), pa.int8()), table.column("doc_id"), table.column("raw"), row.field("file"), row.field("at")],
        names=[*TEXT, "known", "doc_id", "raw", "file", "at"],
    )
    order = pc.sort_indices(keys, sort_keys=[(n, "ascending") for n in keys.column_names])
    texts = [table.column(n).take(order) for n in TEXT]
    changes = np.zeros(len(table) - 1, dtype=bool)
    for column in texts:
        changes |= pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy()
    first = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(table)]])
    kept = order.take(pa.array(first[1:] - 1 if largest else first[:-1]))
    run = table.take(kept).append_column("size", pa.array(np.diff(first), pa.int64()))
    return run.combine_chunks().to_batches()[0]


def _leaves(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
            if count >= LEAF:
                yield _sorted_run(held, largest)
                held, count = [], 0
        if held:
            yield _sorted_run(held, largest)

    return run


def exchanges(spark: SparkSession) -> int:
    """How many exchanges bring a digest from any partition to its own."""
    partitions, found = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while FAN**found < partitions:
        found += 1
    return found


def merged_runs(entries: DataFrame, largest: bool) -> DataFrame:
    """One row a text: run, digest, check, bytes, keep (known, doc_id, raw, row), size.

    Rows move to the partition their run number names. The maximum of a struct makes Spark
    merge by sorting; as the partitions are those of the run, it does so where they are.
    """
    best, known = (F.max, F.col("doc_id").isNotNull()) if largest else (F.min, F.col("doc_id").isNull())
    rounds = exchanges(entries.sparkSession)
    leaves = entries.mapInArrow(_leaves(largest), ENTRIES)
    keep = F.struct(known.alias("known"), "doc_id", "raw", "row").alias("keep")
    run = leaves.select((F.spark_partition_id() % FAN**rounds).alias("run"), *TEXT, keep, "size")
    digit = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    for r in range(rounds):
        place = FAN**r
        own = F.floor(F.col("run") / place) % FAN
        to = F.floor(digit / place) % FAN
        run = run.withColumn("run", (F.col("run") + (to - own) * place).cast("int"))
        run = run.repartitionById(FAN**rounds, "run")
        run = run.groupBy(*TEXT, "run").agg(best("keep").alias("keep"), F.sum("size").alias("size"))
    return run


def merge_runs(entries: DataFrame, area: Area, largest: bool) -> DataFrame:
    """One row a text, staged: digest, check, bytes, keep_id, keep_row, size."""
    run = merged_runs(entries, largest)
    return area.keep(run.select(*TEXT, F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "size"))


def exact_groups(docs: DataFrame, largest: bool = True) -> DataFrame:
    """One row a row of ``docs``: row, doc_id, keep_id, group_size, kept, digest.

    Null text is empty text. Of equal texts the row with the largest id stays (or the
    smallest); a null id loses to any other. Of rows with that same id the one whose text, in
    its own letters, has the largest (or smallest) XXH64 stays, and one of those that repeat
    it. An empty table gives an empty result. Other columns, of whatever name, are ignored.
    """
    area = Area(docs.sparkSession)
    rows = digests(id_and_text(*with_row(docs, area)), area)
    groups = merge_runs(rows, area, largest)
    return rows.join(groups, TEXT).select(
        "row",
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, largest: bool = True) -> DataFrame:
    """``docs`` with one row of each text, in all its columns."""
    area = Area(docs.sparkSession)
    rows, name = with_row(docs, area)
    groups = merge_runs(digests(id_and_text(rows, name), area), area, largest)
    return rows.join(groups.select(F.col("keep_row").alias(name)), name, "left_semi").drop(name)
