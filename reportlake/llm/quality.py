"""Quality by naive Bayes support vectors.

Indicators of hashed byte n-grams are scaled by the logarithm of the ratio of their
smoothed counts in the two classes; a linear hinge-loss model is fitted to the scaled rows
by dual coordinate descent. Margins become probabilities by a logistic curve fitted to the
training rows, weighted to the classes' shares among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import Area, fold, pieces
from reportlake.llm.grams import codes, dual_coordinate_descent, labelled_sample, packed, unpacked

SAMPLE = 3000  # training texts of a class at most
SIZES = (1, 2, 3, 4)
BITS = 17
AT_ONCE = 1_000_000  # bytes of text whose n-grams are held: some 50 bytes each
COST = 1.0
_REPEATS = 16  # places after the n-grams: shares of words equal to the word before
_PLACES = (1 << BITS) + _REPEATS


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """Places that are set in each text: its n-grams, and how often words repeat at once."""
    flags = np.zeros(1 << BITS, dtype=bool)
    out = []
    for text, own in zip(texts, codes(texts, SIZES, BITS)):
        flags[own] = True
        places = np.flatnonzero(flags)
        flags[places] = False
        words = text.split()
        again = sum(a == b for a, b in zip(words, words[1:]))
        share = int(_REPEATS * again / len(words)) if again else -1
        out.append(np.concatenate([places, (1 << BITS) + np.arange(share + 1)]).astype(np.int32))
    return out


class _Scaled(Sequence):
    """Rows as places and scaled values of unit length, made when asked for.

    What is held is bounded by the number of rows: 16 KB of packed places a row, and the
    unpacked row where it has at most ``HELD`` places.
    """

    HELD = 4096

    def __init__(self, rows: list[bytes], unit):
        self.rows, self.unit, self.held = rows, unit, {}

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k >= len(self.rows):
            raise IndexError(k)
        if k in self.held:
            return self.held[k]
        places = unpacked(self.rows[k], _PLACES)
        row = places, self.unit(places)
        if len(places) <= self.HELD:
            self.held[k] = row
        return row


class Model:
    def __init__(self, rows: list[bytes], labels: np.ndarray, shares: np.ndarray):
        """``rows``: packed places. ``shares``: how many rows of class 0 and 1 there are where these were drawn."""
        counts = np.ones((2, _PLACES))
        for data, label in zip(rows, labels):
            counts[label, unpacked(data, _PLACES)] += 1
        logs = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.ratio = logs[1] - logs[0]
        self.constant = None
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(labels) else 0.5
            return
        scaled = _Scaled(rows, self._unit)
        self.weights, self.bias = dual_coordinate_descent(scaled, np.where(labels == 1, 1.0, -1.0), _PLACES, COST)
        margins = np.array([self.weights[p] @ v + self.bias for p, v in scaled])
        drawn = np.bincount(labels, minlength=2)
        self.slope, self.shift = logistic(margins, labels, (shares / drawn)[labels])

    def _unit(self, places: np.ndarray) -> np.ndarray:
        values = self.ratio[places]
        length = np.sqrt(values @ values)
        return values / length if length else values

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        margins = np.array([self.weights[p] @ self._unit(p) + self.bias for p in indicators(texts)])
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift that make margins probabilities, by Newton steps."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    weights = weights / weights.sum()
    target = np.where(labels == 1, 0.999, 0.001)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (p - target)) + 1e-4 * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in pieces(batch, "text", AT_ONCE):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(first, len(texts)),
                    batch.column("draw").slice(first, len(texts)),
                    pa.array([packed(p, _PLACES) for p in indicators(texts)], pa.binary()),
                ],
                names=["label", "draw", "places"],
            )


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fitted on at most ``limit`` texts of each class outside the fold that is held out.

    The sample is of the distinct labelled (id, text) of ``docs``, and shares count these.
    A text of it brings at most 16 KB to the driver, however long it is.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label in (0, 1)").where(fold(F.col("doc_id"), 3) != 1).distinct()
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    narrow = texts.select("doc_id", digest).join(known, "doc_id").select("label", "doc_id", "digest").distinct()
    narrow = Area(docs.sparkSession).keep(narrow)  # labelled texts that are there, each once
    shares = {r.label: r["count"] for r in narrow.groupBy("label").count().collect()}
    drawn = labelled_sample(narrow, "label", F.struct("doc_id", "digest"), limit)  # bounded by the limit
    met = texts.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id").select("doc_id", digest, "text")
    one = ["label", "draw", "doc_id", "digest"]  # a repeated row is down to one a task before it moves
    examples = met.join(F.broadcast(drawn), ["doc_id", "digest"]).groupBy(*one).agg(F.min("text").alias("text"))
    rows = examples.select("label", "draw", "text").mapInArrow(_features, "label int, draw bigint, places binary").collect()
    rows.sort(key=lambda r: (r.label, r.draw, r.places))
    kept, seen = [], {0: 0, 1: 0}
    for r in rows:
        seen[r.label] += 1
        if seen[r.label] <= limit:
            kept.append(r)
    return Model(
        [bytes(r.places) for r in kept],
        np.array([r.label for r in kept], dtype=np.int64),
        np.array([shares.get(0, 0), shares.get(1, 0)], dtype=float),
    )


def scorer(model: Model):
    """A column function of the whole text; null scores as empty."""

    def score(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        found = [model.score(own) for _, own in pieces(batch, "text", AT_ONCE)]
        return pd.Series(np.concatenate(found) if found else np.array([], dtype=float))

    return F.pandas_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, score, predicted.

    Learns from labels 0 and 1 outside the fold that is held out; other labels and labels
    of unknown documents are left out, an id with several labels counts with each. Null
    and empty texts score like any other. Without labels every score is 0.5, with labels of
    one class it is that class. Repeated rows and null ids are kept; other columns are
    ignored.
    """
    model = train(docs, labels, limit)
    score = scorer(model)(F.col("text"))
    held_out = fold(F.col("doc_id"), 3) == 1
    found = docs.select(F.col("doc_id").alias("doc_id"), held_out.alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows predicted to be of class 0, in all columns."""
    return docs.where(scorer(train(docs, labels, limit))(F.col("text")) >= 0.5)
