"""Language identification in two steps: the family, then the language within it.

The family is the best of linear support vector machines, one a family. Within the family
linear machines, one for each pair of its languages, vote. All of them see the same hashed
byte n-grams of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import Area, fold, pieces, with_row
from reportlake.llm.grams import codes, dual_coordinate_descent, labelled_sample

SAMPLE = 600  # training texts of a language at most
TOTAL = 6000  # training texts of all languages at most; at least one each
SIZES = (2, 3, 4)
BITS = 13
UNKNOWN = "und"

# Languages by family. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la ast sc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tt tk ug",
    "semitic": "ar he am mt ti",
    "iranian": "fa ps ku tg",
    "indic": "hi ur bn pa gu mr ne si or as sa",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl",
    "sinitic": "zh yue wuu",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
}
_FAMILY = {language: family for family, members in FAMILIES.items() for language in members.split()}


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], f"only {language}")


def vectors(texts: list[bytes]) -> np.ndarray:
    """Rows of unit length: logarithms of n-gram counts."""
    lower = [t.decode().lower().encode() for t in texts]
    counts = np.stack([np.bincount(c, minlength=1 << BITS) for c in codes(lower, SIZES, BITS)]).astype(np.float32)
    np.log1p(counts, out=counts)
    length = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.where(length > 0, length, 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in pieces(batch, "text"):
            for at in range(0, len(texts), 500):
                rows = vectors(texts[at : at + 500])
                places = [np.flatnonzero(r).astype(np.int32) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(first + at, len(rows)),
                        batch.column("draw").slice(first + at, len(rows)),
                        pa.array([p.tobytes() for p in places], pa.binary()),
                        pa.array([r[p].tobytes() for r, p in zip(rows, places)], pa.binary()),
                    ],
                    names=["label", "draw", "places", "values"],
                )


class Model:
    """Weights of all machines side by side, a column each."""

    def __init__(self, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(set(labels))
        self.families: dict[str, list[int]] = {}
        for k, language in enumerate(self.languages):
            self.families.setdefault(family_of(language), []).append(k)
        of = np.array([self.languages.index(x) for x in labels])
        machines = []
        if len(self.families) > 1:
            for members in self.families.values():
                machines.append((np.ones(len(of), dtype=bool), np.isin(of, members)))
        self.pairs = [pair for members in self.families.values() for pair in combinations(members, 2)]
        machines += [(np.isin(of, pair), of == pair[0]) for pair in self.pairs]
        size = 1 << BITS
        self.weights, self.bias = np.zeros((size, len(machines)), dtype=np.float32), np.zeros(len(machines), dtype=np.float32)
        for k, (used, positive) in enumerate(machines):
            at = np.flatnonzero(used)
            signs = np.where(positive[at], 1.0, -1.0)
            self.weights[:, k], self.bias[k] = dual_coordinate_descent([rows[i] for i in at], signs, size, cost=10.0)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        margins = vectors(texts) @ self.weights + self.bias
        groups = list(self.families.values())
        n = len(texts)
        if len(groups) > 1:
            sure = np.exp(3.0 * (margins[:, : len(groups)] - margins[:, : len(groups)].max(axis=1, keepdims=True)))
            family = sure.argmax(axis=1)
            score = sure.max(axis=1) / sure.sum(axis=1)
            margins = margins[:, len(groups) :]
        else:
            family, score = np.zeros(n, dtype=np.int64), np.ones(n)
        votes = np.zeros((n, len(self.languages)))
        won = np.zeros((n, len(self.languages)))
        for k, (a, b) in enumerate(self.pairs):
            p = 1.0 / (1.0 + np.exp(-3.0 * np.clip(margins[:, k], -30, 30)))
            votes[:, a] += (p >= 0.5) + p * 1e-3  # equal votes: the surer one
            votes[:, b] += (p < 0.5) + (1 - p) * 1e-3
            won[:, a] += p
            won[:, b] += 1 - p
        out, final = [], np.zeros(n)
        for i in range(n):
            members = groups[family[i]]
            best = max(members, key=lambda m: (votes[i, m], -m))
            within = won[i, best] / (len(members) - 1) if len(members) > 1 else 1.0
            out.append(self.languages[best])
            final[i] = score[i] * within
        return out, np.clip(final, 0.0, 1.0)


def train(examples: DataFrame, limit: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """Fitted on at most ``limit`` texts of each label of ``examples`` (row, text, label).

    Many labels share ``total`` texts evenly, and have at least one each. A text brings at
    most 64 KB to the driver, however long it is.
    """
    drawn = labelled_sample(examples.where("label is not null and text is not null"), "label", F.col("row"), limit, total)
    rows = drawn.select("label", "draw", "text").mapInArrow(_features, "label string, draw bigint, places binary, values binary").collect()
    rows.sort(key=lambda r: (r.label, r.draw, r.places))
    kept, seen = [], {}
    for r in rows:
        seen[r.label] = seen.get(r.label, 0) + 1
        if seen[r.label] <= limit:
            kept.append((r.label, (np.frombuffer(r.places, dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32).astype(np.float64))))
    return Model([label for label, _ in kept], [row for _, row in kept]) if kept else None


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                for at in range(0, len(texts), 500):
                    own = texts[at : at + 500]
                    said, score = model.predict(own) if model else ([UNKNOWN] * len(own), np.zeros(len(own)))
                    for k, text in enumerate(own):
                        if not any(map(str.isalpha, text.decode())):
                            said[k], score[k] = UNKNOWN, 0.0
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(n).slice(first + at, len(own)) for n in ("doc_id", "held_out")] + [pa.array(said), pa.array(score)],
                        names=["doc_id", "held_out", "lang_pred", "score"],
                    )

    return run


def identify(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows with text and lang outside the fold that is held out. ``und`` with
    score 0 for null text, text without a letter, and everything if there is nothing to
    learn from. Repeated rows and null ids are kept; other columns are ignored.
    """
    docs, row = with_row(docs, Area(docs.sparkSession))
    held_out = fold(F.col("doc_id"), 3) == 1
    narrow = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("label"), held_out.alias("held_out"))
    model = train(narrow.where(~F.col("held_out")), limit)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    return narrow.select("doc_id", "held_out", "text").mapInArrow(_predict(model), schema)
