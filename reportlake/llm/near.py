"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

A text's fingerprint is the smallest value of each of 125 hash functions over its shingles,
in 25 bands of five: two texts of similarity s share a band with a chance of
1 - (1 - s^5)^25, which is 0.99995 at 0.8. Texts that share one get a long fingerprint of
2,048 bits, each a bit of one more smallest value, so the bits that differ estimate the
similarity with a deviation of 0.013 at 0.8; pairs estimated below 0.742 are left out. All
other pairs are decided by their exact similarity.

A band many texts share is not compared pair by pair at once. First only the pairs of a
spanning forest by estimate are verified; then, of bands that still hold several
components, all pairs of different components. Bands of more than ``BLOCK`` texts are dealt
out as pairs of blocks, so no task holds one as a whole. Equal sets are one fingerprint
from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import Area, id_and_text, pieces, with_row
from reportlake.llm.simhash import components, row_groups

WORDS = 5  # words in a shingle
SHARE = 0.8  # similarity of near copies
BANDS, DEPTH = 25, 5
BITS = 2048
FAR = 264  # differing bits of an estimate of 0.742
BLOCK = 4096
SEED = 5

_rng = np.random.default_rng(SEED)
_ODD = (_rng.integers(0, 1 << 31, size=(3, BITS), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHORT = (_rng.integers(0, 1 << 31, size=BANDS * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of the words between ASCII blanks, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(sizes + 1) - sizes - 1
    end = (start + sizes)[WORDS - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(start.tolist(), end)], dtype=np.uint64))


def smallest(own: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function; ``own`` is not empty."""
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(odd), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(out, (low[at : at + 256, None] * odd[None, :]).min(axis=0), out=out)
    return out


def bands(own: np.ndarray) -> np.ndarray:
    data = smallest(own, _SHORT).tobytes()
    step = 4 * DEPTH
    return np.array([xxhash.xxh64_intdigest(data[k * step : (k + 1) * step], k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def long_print(own: np.ndarray) -> bytes:
    least = smallest(own, _ODD[0])
    return np.packbits(((least * _ODD[1]) ^ _ODD[2]) >> np.uint32(31)).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys = [], []
        for _, texts in pieces(batch, "text", 1_000_000):
            for text in texts:
                own = shingles(text)
                prints.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                keys.append(bands(own).tobytes() if len(own) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(prints, pa.int64()), pa.array(keys, pa.binary())], names=["row", "doc_id", "print", "keys"]
        )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of a print."""
    for batch in batches:
        keys = [np.frombuffer(k.as_py(), dtype=np.int64) for k in batch.column("keys")]
        sizes = np.array([len(k) for k in keys], dtype=np.int64)
        flat = np.concatenate(keys) if keys else np.array([], dtype=np.int64)
        prints = np.repeat(batch.column("print").to_numpy(), sizes)
        band = np.tile(np.arange(BANDS, dtype=np.int32), int((sizes > 0).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(band), pa.array(flat)], names=["print", "band", "key"])


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in pieces(batch, "text", 1_000_000):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n).slice(first, len(texts)) for n in ("print", "keys")),
                    pa.array([long_print(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["print", "keys", "bits", "own"],
            )


def _forest(differ: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which pairs a spanning forest keeps, those with fewest differing bits first."""
    parent, kept = list(range(n)), []
    for k in np.argsort(differ, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _pairs(forest: bool):
    """Pairs to verify of rows sorted by place: a forest, or all of different roots."""

    def settle(prints, band, roots, keys, bits):
        words = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(prints), -1)
        left, right, differ = [], [], []
        step = max(1, 60_000 // len(prints))
        for at in range(0, len(prints), step):
            far = np.bitwise_count(words[at : at + step, None] ^ words[None, at:]).sum(axis=2, dtype=np.int32)
            fine = far <= FAR
            fine &= np.arange(far.shape[0])[:, None] < np.arange(far.shape[1])[None, :]
            if not forest:
                fine &= roots[at : at + step, None] != roots[None, at:]
            x, y = np.nonzero(fine)
            left.append(x + at)
            right.append(y + at)
            differ.append(far[x, y])
        a, b, differ = np.concatenate(left), np.concatenate(right), np.concatenate(differ)
        if forest:
            kept = _forest(differ, a, b, len(prints))
            return a[kept], b[kept]
        own = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(len(prints), -1)
        kept = [np.flatnonzero((own[a[k : k + 10_000]] == own[b[k : k + 10_000]]).argmax(axis=1) == band) + k for k in range(0, len(a), 10_000)]
        kept = np.concatenate(kept) if kept else np.array([], dtype=np.int64)
        return a[kept], b[kept]  # each pair in the first band that it shares

    def frame(group):
        prints = np.array(group[1], dtype=np.int64)
        a, b = settle(prints, group[2][0], np.array(group[3], dtype=np.int64), group[4], group[5])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(prints[a], prints[b])), pa.array(np.maximum(prints[a], prints[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = [[] for _ in range(6)]
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("place", "print", "band", "root", "keys", "bits")]
            ends = (np.flatnonzero(np.diff(batch.column("place").to_numpy())) + 1).tolist()
            for first, end in zip([0, *ends], [*ends, len(batch)]):
                if group[0] and end > first and group[0][0] != columns[0][first]:
                    if len(group[0]) > 1:
                        yield frame(group)
                    group = [[] for _ in range(6)]
                for held, new in zip(group, columns):
                    held += new[first:end]
        if len(group[0]) > 1:
            yield frame(group)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(5 * both >= 4 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _candidates(members: DataFrame, details: DataFrame, forest: bool, area: Area) -> DataFrame:
    """Distinct pairs of ``members`` (print, band, key, n, root) to verify."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = members.withColumn("own", own).withColumn("other", other).select(
        F.when(F.col("n") <= BLOCK, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("place"), "print", "band", "root"
    )
    full = dealt.join(details.select("print", "keys", "bits"), "print")
    sort = full.repartition("place").sortWithinPartitions("place")
    return area.keep(sort.mapInArrow(_pairs(forest), "a bigint, b bigint").distinct())


def _links(pairs: DataFrame, details: DataFrame, area: Area) -> DataFrame:
    x, y = (details.select(F.col("print").alias(p), F.col("own").alias(o)) for p, o in (("a", "x"), ("b", "y")))
    return area.keep(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint"))


def _fingerprint_links(rows: DataFrame, name: str, prints: DataFrame, area: Area) -> DataFrame:
    """Links (a, b) between the prints of rows that SimHash fingerprints group, few enough to connect them."""
    met = area.keep(prints.select("row", "print").join(row_groups(id_and_text(rows, name), area), "row").select("root", "print").distinct())
    hubs = met.groupBy("root").agg(F.min("print").alias("a"), F.max("print").alias("last")).where("a < last").select("root", "a")
    return area.keep(met.join(hubs, "root").where("print <> a").select("a", F.col("print").alias("b")))


def drop_near_copies(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """``docs`` with the row of the smallest id of each group of near copies.

    Groups are what links of a similarity of at least 0.8 connect. With ``fingerprints``
    also what is linked by SimHash fingerprints at three or fewer differing bits, as
    ``simhash.near_groups`` does, is one group: a row goes if links of either kind lead to
    one of a smaller id. Texts of fewer than five
    words have one shingle; texts without words, and null, are copies of each other. Null
    ids come last. An empty table gives an empty result.
    """
    area = Area(docs.sparkSession)
    rows, name = with_row(docs, area)
    schema = "row struct<file bigint, at bigint>, doc_id bigint, print bigint, keys binary"
    prints = area.keep(id_and_text(rows, name).mapInArrow(_prints, schema))
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")
    first = area.keep(prints.groupBy("print").agg(keep, F.min("keys").alias("keys")))
    places = first.select("print", "keys").mapInArrow(_places, "print bigint, band int, key bigint")
    shared = area.keep(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = area.keep(places.join(shared, "key").withColumn("root", F.col("print")))
    met = first.join(members.select("print").distinct(), "print", "left_semi").select("print", "keys", F.col("keep.row").alias(name))
    texts = rows.select(name, F.col("text").alias("text")).join(met, name).select("print", "keys", "text")
    details = area.keep(texts.mapInArrow(_details, "print bigint, keys binary, bits binary, own binary"))

    links = _links(_candidates(members, details, True, area), details, area)
    roots = area.keep(components(links, area).withColumnRenamed("node", "print"))
    named = members.drop("root").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    more = _links(_candidates(named.join(mixed, "key", "left_semi"), details, False, area), details, area)
    links = links.unionByName(more)
    if fingerprints:
        links = links.unionByName(_fingerprint_links(rows, name, prints, area))
    roots = components(links, area).withColumnRenamed("node", "print")

    whole = first.select("print", "keep").join(roots, "print", "left")
    best = whole.groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("keep").alias("keep"))
    return rows.join(best.select(F.col("keep.row").alias(name)), name, "left_semi").drop(name)
