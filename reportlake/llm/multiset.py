"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Every paragraph (a line) hashes to a wide vector, and the fingerprint of a text is the
sum of its paragraphs' vectors, lane by lane modulo a power of two. Order doesn't matter,
a paragraph that comes or goes is added or taken away, and the fingerprint of a
collection is the sum of those of its texts.

The vector has two kinds of lanes. Eight lanes modulo 2^64 are the paragraph's BLAKE2b
digest: texts with equal sums are equal as multisets. ``LANES`` lanes modulo 2^32 count the
paragraph's byte windows with a sign, each window in one lane, so the distance of two
fingerprints estimates in how many windows the texts differ.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import Area, id_and_text, with_row

DIGESTS, LANES = 8, 256
WINDOW = 16  # bytes; at a paragraph's start shorter ones are counted too
_CHUNK = 1 << 20  # bytes hashed at once
SAMPLE = 20  # rows a partition that bounds are drawn from


def _window_counts(text: bytes) -> np.ndarray:
    """Signed counts of the windows that end at each byte of each line."""
    data = np.frombuffer((b"\n" + text).replace(b"\n", b"\0" * WINDOW), dtype=np.uint8)
    counts = np.zeros(2 * LANES, dtype=np.int64)
    for start in range(0, len(data) - WINDOW + 1, _CHUNK):
        part = data[start : start + _CHUNK + WINDOW - 1]
        wide = part.astype(np.uint64)
        for width in (1, 2, 4):  # eight bytes in each place, by doubling
            wide = wide[:-width] | (wide[width:] << np.uint64(8 * width))
        mixed = wide[:-8] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed = (mixed + wide[8:]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        lane = (mixed >> np.uint64(55)).astype(np.int64)[part[WINDOW - 1 :] != 0]
        counts += np.bincount(lane, minlength=2 * LANES)
    return counts[0::2] - counts[1::2]


def vector(text: bytes) -> np.ndarray:
    """The sum of the vectors of the lines of ``text``; an empty line is a line too."""
    digests = b"".join(hashlib.blake2b(line).digest() for line in text.split(b"\n"))
    sums = np.frombuffer(digests, dtype="<u8").reshape(-1, DIGESTS).sum(axis=0, dtype=np.uint64)
    return np.concatenate([sums, _window_counts(text).astype(np.uint64) & np.uint64(0xFFFFFFFF)])


def _reduced(vectors: np.ndarray) -> np.ndarray:
    vectors[..., DIGESTS:] &= np.uint64(0xFFFFFFFF)
    return vectors


def inserted(fingerprint: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The fingerprint with the paragraphs of another one added."""
    return _reduced(fingerprint + more)


def deleted(fingerprint: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The fingerprint with the paragraphs of another one taken away."""
    return _reduced(fingerprint - less)


def encoded(fingerprint: np.ndarray) -> bytes:
    return fingerprint[:DIGESTS].astype("<u8").tobytes() + fingerprint[DIGESTS:].astype("<u4").tobytes()


def decoded(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, "<u8", DIGESTS), np.frombuffer(data, "<u4", offset=8 * DIGESTS)
    return np.concatenate([p.astype(np.uint64) for p in parts])


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """From 0 to 1: the share of windows that two texts have in common, estimated.

    Of a and b, counts by window, it is 1 - |a - b|^2 / (|a|^2 + |b|^2); 1 if both have
    none.
    """
    a, b = (v[DIGESTS:].astype(np.uint32).view(np.int32).astype(np.float64) for v in (one, other))
    whole = float(a @ a + b @ b)
    return 1.0 if not whole else max(0.0, 1.0 - float((a - b) @ (a - b)) / whole)


class Text:
    """A text with its fingerprint, and that of the lines an edit of its end would change."""

    def __init__(self, text: str):
        self.text = text
        self.kept = text[: len(text) - len(text) // 4]
        self.at = self.kept.rfind("\n") + 1
        self.end = vector(text[self.at :].encode())
        self.whole = inserted(vector(text[: self.at - 1].encode()), self.end) if self.at else self.end

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by as much of the following one's start.

        Also gives its fingerprint: the text's own with the changed paragraphs deleted and
        the new ones inserted, so lines before the edit are not hashed again.
        """
        new = self.kept + following[: len(self.text) - len(self.kept)]
        return new, inserted(deleted(self.whole, self.end), vector(new[self.at :].encode()))


def in_order(narrow: DataFrame, size: int) -> DataFrame:
    """The rows in partitions by ascending (doc_id, row), each followed by the next one's first.

    Bounds are rows of the table: the first one and some of a sample of at most ``SAMPLE``
    rows a partition, which decides on the balance alone. Rows that are a bound go to the
    partition before as well, with ``guest`` set, the very first one to the last partition.
    Null ids come first. A text moves once.
    """
    parts = [F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("row.file"), F.col("row.at")]
    keys = narrow.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(parts))).alias("key"))
    least = keys.agg(F.min("key").alias("key")).first().key
    drawn = keys.orderBy(F.xxhash64("key")).limit(SAMPLE * size).collect()
    ranked = sorted({tuple(r.key) for r in drawn})
    bounds = sorted({tuple(least), *(ranked[k * len(ranked) // size] for k in range(1, size))}) if ranked else []

    @F.pandas_udf("array<int>")
    def places(known: pd.Series, ids: pd.Series, files: pd.Series, ats: pd.Series) -> pd.Series:
        out = []
        for key in zip(*(c.tolist() for c in (known, ids, files, ats))):
            place = bisect_right(bounds, key) - 1
            out.append([place, (place - 1) % len(bounds)] if bounds[place] == key else [place])
        return pd.Series(out, dtype=object)

    dealt = narrow.select("*", F.posexplode(places(*parts)).alias("guest", "part")).withColumn("guest", F.col("guest") > 0)
    return dealt.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions(
        "part", "guest", F.col("doc_id").asc_nulls_first(), "row"
    )


_ROW = pa.struct([("file", pa.int64()), ("at", pa.int64())])
FIELDS = {
    "doc_id": ("bigint", pa.int64()),
    "row": ("struct<file bigint, at bigint>", _ROW),
    "n_chars": ("bigint", pa.int64()),
    "edited_sha256": ("string", pa.string()),
    "fingerprint": ("binary", pa.binary()),
    "edited_fingerprint": ("binary", pa.binary()),
    "near_edited": ("double", pa.float64()),
    "near_next": ("double", pa.float64()),
}


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each one that is no guest, from it and the one behind it."""
    held = None
    for batch in batches:
        out = []
        for doc_id, row, text, guest in zip(*(batch.column(c) for c in ("doc_id", "row", "text", "guest"))):
            one = Text(text.as_py() or "")
            if held is not None:
                own_id, own_row, own = held
                new, changed = own.edited(one.text)
                digest = hashlib.sha256(new.encode()).hexdigest()
                near = likeness(own.whole, changed), likeness(own.whole, one.whole)
                out.append((own_id, own_row, len(own.text), digest, encoded(own.whole), encoded(changed), *near))
            held = None if guest.as_py() else (doc_id.as_py(), row.as_py(), one)
        if out:
            columns = [pa.array(list(v), t) for v, (_, t) in zip(zip(*out), FIELDS.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(FIELDS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, row, n_chars, edited_sha256, the two fingerprints, near_edited, near_next.

    ``fingerprint`` is of the text, ``edited_fingerprint`` of the text whose last quarter
    (of code points, rounded down) is replaced by the first as many of the next document
    by ascending id, or by all of them if there are fewer; the last one is followed by the
    first. ``near_edited`` and ``near_next`` are the ``likeness`` of the text's fingerprint to
    the edited text's and to the next text's.

    Null text is empty text, which is one empty paragraph. Null ids come before all others;
    rows of one id follow each other as they lie in their files. A single row is followed
    by itself. Texts with the same lines in another order have the same fingerprint. Other
    columns are ignored, an empty table gives an empty result. A long text is hashed in
    chunks.
    """
    spark = docs.sparkSession
    narrow = id_and_text(*with_row(docs, Area(spark)))
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return in_order(narrow, size).mapInArrow(_followed, ", ".join(f"{n} {t}" for n, (t, _) in FIELDS.items()))
