"""Near duplicates: SimHash fingerprints found by meet-in-the-middle ball hashing.

Two fingerprints within three bits differ in some block of bits, and outside that block in
two bits at most. With the block erased, the balls of radius one around both (half of what
is left of the radius) share a point. So every distinct fingerprint emits, for each erased
block, all its variants within one bit; fingerprints that meet in a variant are verified.

A variant where more than ``GROUP`` fingerprints meet is not compared pair by pair.
Fingerprints of such variants also emit full-length variants: all within one bit, and those
that flip two bits of one half. Of three differing bits two lie in one half, so a linked
pair meets where one of them is within one bit; everything that meets there is linked to
it without further test (1 + 2 = 3). That is linear in the number of fingerprints.

Copies never multiply: fingerprints are made distinct first, and links are only as many
as needed to keep what is linked connected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import Area, id_and_text, offsets, pieces, with_row

WORDS = 3  # words in a shingle
RADIUS = 3  # the scheme above is for three bits
SEED = 42
BLOCKS = ((0, 22), (22, 43), (43, 64))  # bits that are erased together
GROUP = 48  # fingerprints compared pair by pair


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def fingerprint_hashes(text: bytes) -> list[int]:
    """XXH64 of each shingle of the words between ASCII blanks, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= WORDS:
        return [xxhash.xxh64_intdigest(line, SEED)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(sizes + 1) - sizes - 1
    end = (start + sizes)[WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(start.tolist(), end)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprints: a bit is set if it is in over half of the hashes."""
    hashes = [fingerprint_hashes(t) for t in texts]
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full) == 0:
        return out
    flat = np.concatenate([np.array(hashes[k], dtype=np.uint64) for k in full])
    ends = offsets(counts[full])
    ones = np.zeros((len(full), 64), dtype=np.int64)
    for place, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        for at in range(a, b, 1 << 16):
            bits = np.unpackbits(flat[at : min(b, at + (1 << 16))].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[place] += bits.sum(axis=0, dtype=np.int64)
    major = ones * 2 > counts[full][:, None]
    out[full] = np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprints_of(texts).view(np.int64) for _, texts in pieces(batch, "text", 1_000_000)]
        flat = np.concatenate(found) if found else np.array([], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(flat)], names=["row", "doc_id", "print"])


def fingerprints(narrow: DataFrame, area: Area) -> DataFrame:
    """row, doc_id and the fingerprint as a signed long (print), staged."""
    schema = "row struct<file bigint, at bigint>, doc_id bigint, print bigint"
    return area.keep(narrow.mapInArrow(_fingerprint, schema))


def erased_variants() -> list[dict]:
    """Bits kept and bits flipped of each variant; flips also carry the erased block's mark."""
    out = []
    for number, (low, high) in enumerate(BLOCKS):
        keep, mark = ~(((1 << (high - low)) - 1) << low), (number + 1) << low
        flips = [0] + [1 << bit for bit in range(64) if not low <= bit < high]
        out += [{"kept": _signed(keep), "flips": _signed(mark | flip)} for flip in flips]
    return out


def full_variants() -> list[dict]:
    """Bits flipped, and whether near, of the full-length variants."""
    near = [0] + [1 << bit for bit in range(64)]
    halves = (range(32), range(32, 64))
    far = [1 << a | 1 << b for half in halves for a in half for b in half if a < b]
    return [{"flips": _signed(x), "near": True} for x in near] + [{"flips": _signed(x), "near": False} for x in far]


def emit(prints: DataFrame, variants: list[dict], fields: str) -> DataFrame:
    """A row for each print and variant; the variants are a constant of the query."""
    constant = F.from_json(F.lit(json.dumps(variants)), f"array<struct<{fields}>>")
    return prints.select("print", F.inline(constant))


def _spanning(prints: np.ndarray) -> list[tuple[int, int]]:
    """As few links as keep those within the radius connected."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
    left, links = set(range(len(prints))), []
    while left:
        queue = [left.pop()]
        while queue:
            one = queue.pop()
            for other in np.flatnonzero(near[one]).tolist():
                if other in left:
                    left.remove(other)
                    queue.append(other)
                    links.append((one, other))
    return links


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) of rows sorted by key; (a, a) marks one of a large group.

    Holds one group of at most ``GROUP`` fingerprints besides the batch.
    """

    def frame(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=np.uint64).view(np.int64)), pa.array(np.asarray(b, dtype=np.uint64).view(np.int64))], names=["a", "b"])

    def settle(keys, prints):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        two = first[size == 2]
        a, b = prints[two], prints[two + 1]
        good = np.bitwise_count(a ^ b) <= RADIUS
        left, right = [a[good]], [b[good]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            group = prints[at : at + n]
            if n > GROUP:
                left.append(group)
                right.append(group)
            elif links := _spanning(group):
                x = np.array(links)
                left.append(group[x[:, 0]])
                right.append(group[x[:, 1]])
        return frame(np.concatenate(left), np.concatenate(right))

    nothing = np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    (keys, prints), large = nothing, None
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
        if large is not None:  # the rest of a group that is already known to be large
            rest = int(np.searchsorted(keys, large, side="right"))
            if rest:
                yield frame(prints[:rest], prints[:rest])
                keys, prints = keys[rest:], prints[rest:]
        if len(keys):
            large = None
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield settle(keys[:last], prints[:last])
            keys, prints = keys[last:], prints[last:]
            if len(keys) > GROUP:
                large = keys[-1]
                yield frame(prints, prints)
                keys, prints = nothing
    if len(keys):
        yield settle(keys, prints)


def link(prints: DataFrame, area: Area) -> DataFrame:
    """Links (a, b) that connect all distinct ``prints`` within the radius."""
    kept, flips = F.col("kept"), F.col("flips")
    keys = emit(prints, erased_variants(), "kept bigint, flips bigint").select(
        F.col("print").bitwiseAND(kept).bitwiseXOR(flips).alias("key"), "print"
    )
    met = area.keep(
        keys.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a bigint, b bigint").distinct()
    )
    links = met.where("a <> b")
    large = met.where("a = b").select(F.col("a").alias("print"))
    if large.isEmpty():
        return links
    points = area.keep(
        emit(large, full_variants(), "flips bigint, near boolean").select(
            F.col("print").bitwiseXOR(flips).alias("key"), "print", "near"
        )
    )
    hubs = points.where("near").groupBy("key").agg(F.min("print").alias("hub"))
    star = points.join(hubs, "key").where("print <> hub").select(F.col("hub").alias("a"), F.col("print").alias("b"))
    return links.unionByName(star.distinct())


def components(links: DataFrame, area: Area) -> DataFrame:
    """(node, root) of all linked nodes, by alternating large-star and small-star steps.

    A step keeps what is connected and ends when nothing changes; then every node points
    to the smallest node of its component.
    """
    edges = area.keep(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        edges = area.keep(large)
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        small = edges.join(low, "v")
        edges = area.keep(
            small.select("v", F.col("m").alias("u")).union(small.select(F.col("u").alias("v"), F.col("m").alias("u"))).where("u <> v").distinct()
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("v")).first()
        if now == before or now[0] == now[2] and _flat(edges):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def _flat(edges: DataFrame) -> bool:
    """Whether no root points anywhere."""
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def near_groups(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: row, doc_id, fingerprint, component_id.

    Null text counts as empty; a text without words has fingerprint zero and links like
    any other. ``component_id`` is the smallest non-null id reachable by links of at most
    three differing bits (null if there is none). Repeated rows are kept. An empty table
    gives an empty result. Other columns, of whatever name, are ignored.
    """
    area = Area(docs.sparkSession)
    return _grouped(fingerprints(id_and_text(*with_row(docs, area)), area), area).select(
        "row", "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def row_groups(narrow: DataFrame, area: Area) -> DataFrame:
    """(row, root) of rows of row, doc_id and text: linked rows have the same root."""
    rows = fingerprints(narrow, area)
    roots = components(link(rows.select("print").distinct(), area), area)
    return rows.join(roots.withColumnRenamed("node", "print"), "print", "left").select("row", F.coalesce("root", "print").alias("root"))


def _grouped(rows: DataFrame, area: Area) -> DataFrame:
    first = area.keep(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")))
    roots = components(link(first.select("print"), area), area)
    named = first.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root"), "first", "keep")
    best = named.groupBy("root").agg(F.min("first").alias("component_id"), F.min("keep").alias("keep"))
    of = area.keep(named.select("print", "root").join(best, "root").select("print", "component_id", F.col("keep.row").alias("keep_row")))
    return rows.join(of, "print")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the smallest id of each group of near copies."""
    area = Area(docs.sparkSession)
    rows, name = with_row(docs, area)
    groups = _grouped(fingerprints(id_and_text(rows, name), area), area)
    kept = groups.where("row = keep_row").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)
