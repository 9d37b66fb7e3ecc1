"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are words of letters and digits, lower-cased. A seed hashes six of eight consecutive
words; two fixed masks say which. The masks are chosen so that any thirteen aligned words
of which at least eleven are equal hold a seed without a substitution: every such stretch
is hit. An item of fewer words counts whole: of its n words four in five must be equal, so
s may differ, and it is cut into s + 1 pieces, masks that ignore all its other words, of
which one is without a substitution. Around a hit, the aligned words of document and item
are compared.

The seeds of the benchmark are broadcast. If there are more than ``BLOCK_SEEDS`` rows of
them, they are dealt into blocks of about that many, whose hits are found and written one
block after another: one block is held at a time, and the documents are scanned once a
block. Documents are never shuffled; hits leave the scan as one narrow row each, after
they have been verified and reduced to one row a document and item.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import Area, text_of, with_row

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))  # word positions that are hashed
SPAN = 8
WINDOW = 13  # aligned words
SHARE = 0.8  # of them that must be equal
BLOCK_SEEDS = 200_000  # rows of 18 words each
NOT_WORD = r"[^\p{L}\p{N}]+"


def needed(size: int) -> int:
    """How many of ``size`` aligned words must be equal."""
    return math.ceil(size * SHARE - 1e-9)


def pieces_of(size: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of an item of fewer than ``WINDOW`` words."""
    parts = size - needed(size) + 1
    cuts = [size * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


PIECES = sorted({n for size in range(1, WINDOW) for _, n in pieces_of(size)})
# All masks by number: the spaced ones, then pieces by their length.
SHAPES = (*MASKS, *(tuple(range(n)) for n in PIECES))

_BEFORE = WINDOW - SPAN
# What can stand around a seed: windows that hold it, or the rest of a short item.
_FIRST = max(_BEFORE, *(a for size in range(1, WINDOW) for a, _ in pieces_of(size)))
_AROUND = range(-_FIRST, WINDOW)


def words_of(column: str = "text") -> Column:
    return F.split(F.lower(text_of(column)), NOT_WORD)


def _hash(words: Column, at: Column, shape: int) -> Column:
    """The shape's number is hashed with the words; null where it doesn't fit."""
    mask = SHAPES[shape]
    whole = F.xxhash64(F.lit(shape), *[F.get(words, at + k) for k in mask])
    return F.when(at + mask[-1] < F.size(words), whole)


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """seed, shape, item_id, the item's words around it, and how many must be equal."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.filter(words_of(), lambda w: w != "").alias("words"))
    size = F.size("words")
    last = size - WINDOW + _BEFORE  # where an eight-word seed still fits
    spaced = F.transform(
        F.when(last >= _BEFORE, F.sequence(F.lit(0), last)),
        lambda at: F.array(*[F.struct(at.alias("at"), F.lit(n).alias("shape")) for n in range(len(MASKS))]),
    )
    short = F.lit(None)
    for n in range(1, WINDOW):
        own = [F.struct(F.lit(a).alias("at"), F.lit(len(MASKS) + PIECES.index(k)).alias("shape")) for a, k in pieces_of(n)]
        short = F.when(size == n, F.array(*own)).otherwise(short)
    placed = items.withColumn("p", F.explode(F.coalesce(F.flatten(spaced), short))).select("item_id", "words", "p.at", "p.shape")
    seed = F.lit(None)
    for n in range(len(SHAPES)):
        seed = F.when(F.col("shape") == n, _hash(F.col("words"), F.col("at"), n)).otherwise(seed)
    around = F.array(*[F.get("words", F.col("at") + r) for r in _AROUND])
    need = F.lit(needed(WINDOW))
    for n in range(1, WINDOW):
        need = F.when(size == n, needed(n)).otherwise(need)
    return placed.select(
        "item_id", around.alias("item_words"), need.alias("need"), (size < WINDOW).alias("whole"), "shape", seed.alias("seed")
    )


def _best_window() -> Column:
    """Most equal words in any window around a hit that holds the seed; of short items in all."""
    equal = F.zip_with("doc_words", "item_words", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    starts = F.sequence(F.lit(1 + _FIRST - _BEFORE), F.lit(1 + _FIRST))
    total = lambda some: F.aggregate(some, F.lit(0), lambda x, y: x + y)
    windows = F.array_max(F.transform(starts, lambda o: total(F.slice(equal, o, WINDOW))))
    return F.when(F.col("whole"), total(equal)).otherwise(windows)


def _hits(docs: DataFrame, seeds: DataFrame, shapes: list[int], by: list[str]) -> DataFrame:
    """Verified hits; only the ``shapes`` that the seeds have are hashed."""
    placed = docs.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    hashes = F.array(*[_hash(F.col("words"), F.col("at"), n) for n in shapes])
    places = placed.select("row", "doc_id", "words", "at", F.explode(hashes).alias("seed"))
    around = F.array(*[F.get("words", F.col("at") + r) for r in _AROUND])
    # A generated column keeps the test out of the join's condition, where its code would
    # make the loop over all places too large to be compiled.
    met = places.join(F.broadcast(seeds), "seed").select(
        "row", "doc_id", *by, "at", "need", "whole", "item_words", F.explode(F.array(around)).alias("doc_words")
    )
    return met.select("row", "doc_id", *by, "at", "need", _best_window().alias("equal_words")).where("equal_words >= need")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document row and item that overlap: row, doc_id, item_id, first_word, equal_words.

    They overlap where at least eleven of thirteen aligned words are equal; of items with
    fewer words all count, and four in five of them must be equal, rounded up, so items of
    up to four words match copies alone. All such overlaps are found. Null and empty items
    and texts match nothing. ``first_word`` is the word at which the first seed hit. Null
    ids are kept, repeated rows give rows of their own, and other columns, of whatever
    name, are ignored. Empty tables give an empty result.
    """
    area = Area(docs.sparkSession)
    rows, name = with_row(docs, area)
    return _overlaps(rows, name, benchmark_seeds(benchmark), area, ["item_id"])


def _overlaps(rows: DataFrame, name: str, seeds: DataFrame, area: Area, by: list[str]) -> DataFrame:
    narrow = rows.select(F.col(name).alias("row"), F.col("doc_id").alias("doc_id"), words_of().alias("words"))
    seeds = area.keep(seeds)
    shapes = {r["shape"]: r["count"] for r in seeds.groupBy("shape").count().collect()}
    blocks = max(1, -(-sum(shapes.values()) // BLOCK_SEEDS))

    def reduced(part: DataFrame) -> DataFrame:
        found = _hits(narrow, part.drop("shape"), sorted(shapes) or [0], by)
        return found.groupBy("row", "doc_id", *by).agg(F.min("at").alias("first_word"), F.max("equal_words").alias("equal_words"))

    if blocks == 1:
        return reduced(seeds)
    # any row may go to any block, so one seed on very many rows is spread as well
    dealt = F.pmod(F.xxhash64(*seeds.columns), F.lit(blocks))
    parts = [area.keep(reduced(seeds.where(dealt == k))) for k in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("row", "doc_id", *by).agg(F.min("first_word").alias("first_word"), F.max("equal_words").alias("equal_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap an item, in all columns.

    A passage that many items share is one seed row here.
    """
    area = Area(docs.sparkSession)
    rows, name = with_row(docs, area)
    seeds = benchmark_seeds(benchmark).drop("item_id").distinct()
    found = _overlaps(rows, name, seeds, area, []).select(F.col("row").alias(name)).distinct()
    return rows.join(found, name, "left_anti").drop(name)
