"""Embedding whitening: principal directions of distinct vectors, scaled to unit variance.

Vectors become whole numbers. The distinct ones are counted, summed and centred exactly;
each task reduces its rows to a triangle by QR block by block, and triangles are merged a
few at a time until one is left, so the covariance is never formed. Its singular values
and vectors come from ``bidiagonal``. What passes the driver is of the size of the
dimensions alone: their sums, the last triangle, and the covariance of the few components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.bidiagonal import leading_components
from reportlake.llm.common import Area

SCALE, COMPONENTS = 256, 4
FAN = 16  # triangles merged in one group of a round
_ZERO = 1e-26  # an eigenvalue this small beside the largest one is rounding


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x, the floor of 256 times each entry, of the rows that have only finite entries."""
    v = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = v.isNotNull() & F.forall(v, lambda c: finite(c.cast("double")))
    return rows.where(good).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("x")
    )


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """The vectors of an Arrow column as rows; missing last entries are zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a dimension and batch: number, rows in the batch, sum as text of the exact number."""
    for batch in batches:
        lengths = np.diff(batch.column("x").offsets.to_numpy())
        x = _matrix(batch.column("x"), int(lengths.max(initial=0)))
        safe = float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, len(x)) < 2.0**62
        sums = (x if safe else x.astype(object)).sum(axis=0).tolist() if x.size else []
        number = [-1, *range(len(sums))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array([str(len(x)), *map(str, sums)], pa.string())], names=["number", "total"]
        )


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""
    parts = fit.select("x").mapInArrow(_sums, "number int, total string")
    rows = parts.groupBy("number").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r.number: int(r.total) for r in rows}
    return found.get(-1, 0), [found[k] for k in range(len(found) - 1)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return x - np.array([s / n for s in sums])


_TRIANGLE = "place int, triangle binary"


def triangle(fit: DataFrame, n: int, sums: list[int], area: Area) -> np.ndarray:
    """R with R'R = the sum of outer products of centred rows.

    A task reduces its rows batch by batch; ``FAN`` of what is left meet in each round.
    """
    width = len(sums)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            rows = _centred(_matrix(batch.column("x"), width), n, sums)
            r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
        if len(r):
            place = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([place, pa.array([r.tobytes()], pa.binary())], names=["place", "triangle"])

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        stack = [np.frombuffer(t).reshape(-1, width) for t in group.sort_values("place").triangle]
        r = np.linalg.qr(np.concatenate(stack), mode="r")
        return pd.DataFrame({"place": [key[0]], "triangle": [r.tobytes()]})

    parts = area.keep(fit.select("x").mapInArrow(reduced, _TRIANGLE))
    left = parts.agg(F.max("place").alias("last")).first().last + 1
    while left > 1:
        left = -(-left // FAN)
        parts = parts.groupBy(F.floor(F.col("place") / FAN).cast("int").alias("key")).applyInPandas(merged, _TRIANGLE)
    r = np.frombuffer(parts.first().triangle).reshape(-1, width)
    return np.concatenate([r, np.zeros((width - len(r), width))])


class Model:
    """Number and sums of the distinct vectors, and the directions found in them."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        """``values``: eigenvalues of the covariance, falling; ``vectors``: of the first, in rows."""
        self.n, self.sums, self.vectors = n, sums, vectors
        trace = float(values.sum())
        self.variances = values[: len(vectors)]
        self.real = self.variances > _ZERO * float(values.max(initial=0))
        self.explained = [float(v) / trace if trace else None for v in self.variances]
        self.identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, over their deviations; of no meaning where ``real`` is false."""
        scale = np.sqrt(np.where(self.real, self.variances, 1.0))
        return _centred(x, self.n, self.sums) @ self.vectors.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n x - S in each row, exact; None beyond the range of a long."""
        most = float(np.abs(x.astype(np.float64)).max(initial=0))
        bound = self.n * most + max(map(abs, self.sums), default=0)
        exact = np.int64 if bound * bound * max(1, len(self.sums)) < 2.0**62 else object
        away = self.n * x.astype(exact) - np.array(self.sums, dtype=exact)
        return [int(v) if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry of the covariance of the whitened fit list less the identity."""
    real = np.flatnonzero(model.real)
    if not len(real):
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.whitened(_matrix(batch.column("x"), len(model.sums)))[:, real]
            total = (w.T @ w).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["number", "total"]
            )

    rows = fit.select("x").mapInArrow(products, "number int, total double").groupBy("number").agg(F.sum("total").alias("total"))
    covariance = np.zeros(len(real) ** 2)
    for r in rows.collect():
        covariance[r.number] = r.total / model.n
    return float(np.abs(covariance.reshape(len(real), -1) - np.eye(len(real))).max())


def fit(rows: DataFrame, count: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of ``rows`` (column x); None without a dimension."""
    area = Area(rows.sparkSession)
    distinct = area.keep(rows.select("x").distinct())
    n, sums = totals(distinct)
    if not n or not sums:
        return None
    values, _, vectors = leading_components(triangle(distinct, n, sums, area), min(count, len(sums)))
    model = Model(n, sums, values / n, vectors)
    model.identity_error = _identity_error(distinct, model)
    return model


_OUT = {
    "vec_id": ("bigint", pa.int64()),
    "component": ("int", pa.int32()),
    "n": ("bigint", pa.int64()),
    "deviation": ("bigint", pa.int64()),
    "whitened": ("double", pa.float64()),
    "explained": ("double", pa.float64()),
    "identity_error": ("double", pa.float64()),
}


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """A row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or an entry that is not finite are left out.
    Entries are the floor of 256 times the given ones, held to the range of a long. The
    model is fitted on each distinct vector once: ``n`` vectors with sums S. ``deviation``
    is the sum over dimensions of (n x - S)^2, null where a long can't hold it.
    ``whitened`` is the centred vector on the unit eigenvector of the covariance, over the
    root of its eigenvalue; ``explained`` that eigenvalue over the trace; ``identity_error`` of
    all components together. There are ``count`` components, or one a dimension if there
    are fewer.

    A component without variance (one vector, or fewer than there are dimensions) has null
    in ``whitened`` and takes no part in ``identity_error``; without any variance
    ``explained`` and ``identity_error`` are null. Vectors shorter than the longest count as
    zero where they end. An empty table, or vectors of no entry alone, give an empty
    result. Ids may repeat or be null, other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in _OUT.items())
    model = fit(rows, count)
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.vectors)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), len(model.sums))
            size = len(x)
            values = (
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(size), k))),
                np.tile(np.arange(1, k + 1), size),
                np.full(size * k, model.n),
                [d for d in model.deviations(x) for _ in range(k)],
                np.where(model.real, model.whitened(x), np.nan).ravel(),
                model.explained * size,
                [model.identity_error] * (size * k),
            )
            columns = [v if isinstance(v, pa.Array) else pa.array(v, t, from_pandas=isinstance(v, np.ndarray)) for v, (_, t) in zip(values, _OUT.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(_OUT))

    return rows.mapInArrow(described, schema)
